from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftstone.streaming import sink

SCHEMA = "id long, text string"


def start(spark, folder, fail=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
    if fail is not None:
        stream = stream.withColumn("text", F.when(F.col("id") == fail, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))
    stream.repartition(3).writeStream.format("committed").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start().awaitTermination()


def ids(spark, folder):
    return sorted(r.id for r in sink.delivered(spark, str(folder / "out"), SCHEMA).collect())


def test_batches_come_whole_or_not_at_all(spark, tmp_path):
    sink.register(spark)
    for n in range(3):
        spark.createDataFrame([(100 * n + i, f"t{i}") for i in range(30)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    assert ids(spark, tmp_path) == []
    with pytest.raises(Exception):
        start(spark, tmp_path, fail=107)  # in the second batch
    assert ids(spark, tmp_path) == list(range(30)) and [b["batch"] for b in sink.batches(str(tmp_path / "out"))] == [0]
    start(spark, tmp_path)
    assert ids(spark, tmp_path) == [100 * n + i for n in range(3) for i in range(30)]
    assert [(b["batch"], b["rows"]) for b in sink.batches(str(tmp_path / "out"))] == [(0, 30), (1, 30), (2, 30)]
    start(spark, tmp_path)  # nothing new
    assert len(ids(spark, tmp_path)) == 90


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path):
    import pyarrow as pa

    writer = sink._Writer(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["a", None]})
    writer.commit([writer.write(iter([batch])), writer.write(iter([]))], 4)
    again = writer.write(iter([batch]))
    assert len(sink.orphans(str(tmp_path / "out"))) == 1
    writer.commit([again], 4)
    assert ids(spark, tmp_path) == [1, 2] and sink.orphans(str(tmp_path / "out")) == []
    lost = writer.write(iter([batch]))
    writer.abort([lost, None], 5)
    assert ids(spark, tmp_path) == [1, 2] and sink.orphans(str(tmp_path / "out")) == []
