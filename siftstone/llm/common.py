"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
LAST_KEY = 2**63 - 1
#: Spark's setting that removes a statement's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def least_rows(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Of the rows that share the keys the least by the named columns (those
    that cannot be ordered are left out of the order), with these columns."""
    ordered = [f.name for f in rows.schema if f.name in names and f.dataType.typeName() not in ("map", "variant")]
    of = lambda some: F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate(some)))
    least = F.min(of(names)) if len(ordered) == len(names) else F.min_by(of(names), of(ordered))
    found = rows.groupBy(*(col(k) for k in keys)).agg(least.alias("least_of_rows"))
    return found.select(*(F.col(f"least_of_rows.c{i}").alias(c) for i, c in enumerate(names)))


def shuffle_width(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """How many partitions hold ``df`` at about ``bytes_each`` each, and at
    least the session's shuffle partitions; these alone where the planner does
    not know the size (rows that are not read from files)."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if known >= 1 << 60 else max(least, min(known // bytes_each, 100_000))


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``; one
    of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        import tempfile

        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(where)


class Store:
    """Tables written to the shared checkpoint folder and read again, which
    cuts lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, tidy: bool = False):
        """``tidy`` also removes the shuffle files of a kept table, once it is written."""
        import uuid

        ready_checkpoints(spark)
        self.spark, self.tidy = spark, tidy
        self.home = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        self.made = 0
        system, path = self._at(self.home)
        system.mkdirs(path)
        system.deleteOnExit(path)  # with the driver's end

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        where = f"{self.home}/{self.made}"
        before = self.spark.conf.get(CLEANUP, None)
        try:
            if self.tidy:
                self.spark.conf.set(CLEANUP, "true")
            df.write.parquet(where)
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, number: int) -> None:
        """Delete the table kept as the given number, once nothing reads it."""
        system, path = self._at(f"{self.home}/{number}")
        system.delete(path, True)
