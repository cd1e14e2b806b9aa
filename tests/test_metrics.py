from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from siftstone.streaming import metrics

SCHEMA = "id long, source string, content string"


def rows(n):
    return [(i, f"s{i % 3}", None if i % 7 == 0 else f"text {i}") for i in range(n)]


def test_steps_of_a_batch_equal_plain_counts(spark, tmp_path):
    log, df = metrics.StepLog(), spark.createDataFrame(rows(50), SCHEMA).repartition(3)
    read = log.step("read", df, empty=F.count_if(F.col("content").isNull()))
    log.step("kept", read.where("content is not null"), longest=F.max(F.length("content"))).write.parquet(str(tmp_path / "out"))
    got = {(r.step, r.metric): r.value for r in log.table(spark).collect()}
    assert got == {("read", "rows"): 50, ("read", "empty"): 8, ("kept", "rows"): 42, ("kept", "longest"): 7}


def waited(spark, path, enough):
    for _ in range(60):  # the listener hears of a batch a little later
        try:
            if enough(spark.read.schema(metrics.STEPS).parquet(path)):
                return
        except Exception:  # nothing is written yet
            pass
        time.sleep(0.5)
    raise AssertionError("the step table stays short")


def test_a_stream_fills_the_step_table(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame(rows(20 + n), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    table = str(tmp_path / "steps")
    listener = metrics.IngestListener(spark, table, ("ingest", "broken"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        seen = metrics.observed(stream, "read", empty=F.count_if(F.col("content").isNull()))
        kept = metrics.observed(seen.where("content is not null"), "kept")
        start = lambda df, name: df.writeStream.queryName(name).format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        start(kept, "ingest").awaitTermination()
        with pytest.raises(Exception):
            start(stream.select(F.raise_error(F.lit("no")).cast("string").alias("x")), "broken").awaitTermination()
        waited(spark, table, lambda t: t.where("metric = 'failed'").count() and t.where("step = 'kept' and batch = 2").count())
    finally:
        spark.streams.removeListener(listener)
    steps = spark.read.schema(metrics.STEPS).parquet(table)
    got = {(r["query"], r.step, r.metric): r.value for r in metrics.totals(steps.union(steps)).collect() if not r.metric.endswith("_ms")}
    whole = spark.read.parquet(*(str(tmp_path / "in" / f"{n}") for n in range(3)))
    assert got[("ingest", "read", "rows")] == whole.count() == got[("ingest", "batch", "input_rows")]
    assert got[("ingest", "read", "empty")] == whole.where("content is null").count()
    assert got[("ingest", "kept", "rows")] == spark.read.parquet(str(tmp_path / "ingest")).count()
    assert got[("broken", "query", "failed")] == 1
