"""Tables that several jobs read: written once, so that no job computes them
again and a lost executor costs no more than a file read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``;
    in one of our own only in local mode, where none is set.  It goes with the
    driver's end."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            import tempfile

            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
    where = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return where


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again."""
    where = f"{folder(df.sparkSession)}/rows"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key where its scan has fewer tasks than the cluster
    has cores, as for one small file; a larger scan keeps its own tasks."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
