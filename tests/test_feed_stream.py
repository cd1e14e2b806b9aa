from __future__ import annotations

from siftstone.sources import streams


def feed(*names):
    return "<rss><channel>" + "".join(f"<item><guid>{n}</guid><title>T {n}</title></item>" for n in names) + "</channel></rss>"


def test_a_poll_is_read_by_feed_and_replays(spark, tmp_path):
    spark.dataSource.register(streams.FeedSource)
    a, b = tmp_path / "a.xml", tmp_path / "b.xml"
    a.write_text(feed("a1", "a2"))
    b.write_text(feed("b1"))

    def poll():
        stream = spark.readStream.format("feed").option("urls", f"{a},{b}").option("archive", str(tmp_path / "archive")).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.entry_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert poll() == ["a1", "a2", "b1"]
    a.write_text(feed("a2", "a3"))
    assert poll() == ["a1", "a2", "a3", "b1"]  # a restart repeats nothing
    assert poll() == ["a1", "a2", "a3", "b1"]
    table = spark.read.format("feed").option("urls", f"{a},{b}").load()
    assert sorted(r.entry_id for r in table.collect()) == ["a2", "a3", "b1"] and table.rdd.getNumPartitions() == 2


def test_an_offset_gives_the_same_rows_again(tmp_path):
    a, archive = tmp_path / "a.xml", str(tmp_path / "archive")
    a.write_text(feed("x"))
    reader = streams.FeedSource({"urls": str(a), "archive": archive}).streamReader(None)
    (first,) = reader.partitions({"poll": 0}, {"poll": 5})
    assert [e[0] for e in reader.read(first)] == ["x"]
    a.write_text(feed("x", "y"))
    assert [e[0] for e in reader.read(first)] == ["x"]  # as it was at that poll
    (second,) = reader.partitions({"poll": 5}, {"poll": 9})
    assert [e[0] for e in reader.read(second)] == ["y"] == [e[0] for e in reader.read(second)]
