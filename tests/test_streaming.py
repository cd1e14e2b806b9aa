from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftstone.sources import files, streams
from siftstone.streaming import pipelines

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
ROWS = [(i, f"2024-01-{1 + i % 9:02d} {i % 24:02d}:00:00", i % 5, "ab"[i % 2], float(i)) for i in range(200)]


@pytest.fixture()
def folder(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def collected(spark, stream, tmp_path, mode):
    out = {}

    def sink(batch, number):
        for r in batch.collect():
            out[tuple(r)[:3]] = tuple(r)

    pipelines.run_available(stream, sink, str(tmp_path / "cp"), mode)
    return out


def test_windows_on_a_stream_equal_the_batch(spark, folder, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = collected(spark, pipelines.windowed_counts(pipelines.timed(stream, delay="60 days")), tmp_path, "update")
    batch = {tuple(r)[:3]: tuple(r) for r in pipelines.windowed_counts(spark.read.parquet(folder)).collect()}
    assert got == batch and len(batch) > 9


def test_unseen_ids(spark, folder, tmp_path):
    both = spark.read.parquet(folder)
    both.union(both).repartition(2).write.parquet(str(tmp_path / "twice"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "twice"))
    got = collected(spark, pipelines.unseen(pipelines.timed(stream, delay="60 days"), "event_id"), tmp_path, "append")
    assert len(got) == len(ROWS) and pipelines.unseen(both.union(both), "event_id").count() == len(ROWS)


def test_custom_state(spark, folder, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = {}
    pipelines.run_available(pipelines.running_totals(stream), lambda b, n: out.update({r.user_id: r.n for r in b.collect()}), str(tmp_path / "cp2"), "update")
    assert out == {u: 40 for u in range(5)}


def test_sessions_and_late_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (1, "2024-01-02 00:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in pipelines.sessions(df).collect()) == [1, 2]
    now, late = pipelines.split_late(df, F.lit("2024-01-08 12:00:00").cast("timestamp"), 7)
    assert (now.count(), late.count()) == (1, 2)


def test_near_duplicates_against_history(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [("a", base), ("b", "other words that share nothing with the first one"), ("c", base + " x"), ("d", base)]
    for n, (i, t) in enumerate(texts):
        spark.createDataFrame([(i, t, n)], "id string, content string, n int").write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, content string, n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sink = pipelines.NearDuplicateSink(str(tmp_path / "out"))
    seen = []
    pipelines.run_available(stream, lambda b, n: (seen.append(n), sink(b, n)), str(tmp_path / "cp"))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out" / "items")).collect()}
    assert len(got) == 4 and got["b"].duplicate_of is None
    group = [got[i].duplicate_of for i in "acd"]
    assert group.count(None) == 1 and len(seen) >= 2
    sent = []
    pipelines.notify(spark.read.parquet(str(tmp_path / "out" / "items")), lambda df: sent.append(df.count()))
    assert sent == [2]


def test_near_duplicate_history_expires(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    sink = pipelines.NearDuplicateSink(str(tmp_path / "out"), keep=1)
    for n, t in enumerate((text, "some other words", text, text)):
        sink(spark.createDataFrame([(f"i{n}", t)], "id string, content string"), n)
    sink(spark.createDataFrame([("i3", text)], "id string, content string"), 3)  # retried
    got = {r.id: r.duplicate_of for r in spark.read.parquet(str(tmp_path / "out" / "items")).collect()}
    assert got == {"i0": None, "i1": None, "i2": None, "i3": "i2"}
    assert sorted(p.name for p in (tmp_path / "out" / "bands").glob("batch=*")) == ["batch=2", "batch=3"]


def test_session_state(spark, tmp_path):
    rows = [(1, 1, 0, "s1", "Ada"), (1, 1, 1, "s2", None), (1, 1, 2, "s1", "Bob"), (2, 1, 0, None, None)]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "user_id long, session_id long, turn long, cited string, entity string").write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, session_id long, turn long, cited string, entity string").option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    seen = []
    pipelines.run_available(pipelines.session_state(stream, 2), lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp"), "update")
    last = {r.user_id: r for r in seen if r.turns == (3 if r.user_id == 1 else 1)}
    assert sorted(last[1].cited) == ["s1", "s2"] and sorted(last[1].entities) == ["Ada", "Bob"] and last[2].cited == []


def test_webhooks_and_logs(spark):
    as_of = F.lit("2024-01-31").cast("timestamp")
    payloads = ['{"id": "1", "content": "x", "timestamp": "2024-01-02T03:04:05", "priority": 9, "content_type": "NEWS"}', '{"id": "2"}', '{"id": "3", "content": " "}', '{"content": "y", "timestamp": "bad", "content_type": "odd"}', "broken"]
    got = sorted(streams.webhook_items(spark.createDataFrame([(p,) for p in payloads], "value string"), as_of).collect(), key=lambda r: r.content)
    assert [(r.content, r.content_type, str(r.ts), r.priority) for r in got] == [("x", "news", "2024-01-02 03:04:05", 5), ("y", "generic", "2024-01-31 00:00:00", 3)]
    lines = spark.createDataFrame([("INFO then ERROR", 1), ("error here", 2), ("  ", 3), ("INFO then ERROR", 4), ("plain", 5)], "value string, n int")
    logs = streams.log_items(lines, as_of, place=F.col("n")).collect()
    assert sorted(r.level for r in logs) == ["ERROR", "INFO", "INFO", "INFO"] and len({r.id for r in logs}) == 4


FEED = """<rss><channel><item><guid>https://www.example.com/1</guid><title>A &lt;b&gt;bold&lt;/b&gt; title</title><description>text</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>
<item><guid>https://www.example.com/2</guid><title>Second</title></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    spark.dataSource.register(streams.FeedSource)
    entries = spark.read.format("feed").option("urls", str(tmp_path / "f.xml")).load()
    items = {r.title: r for r in streams.feed_items(entries, F.lit("2024-01-31").cast("timestamp")).collect()}
    assert len({r.id for r in items.values()}) == 2 and str(items["A <b>bold</b> title"].ts) == "2024-01-02 03:04:05"
    assert items["A <b>bold</b> title"].content == "A bold title\ntext" and streams.parse_feed("<rss") == []


def test_simulated_items(spark):
    rows = spark.range(50).select(F.col("id").alias("value"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    got = streams.simulated(rows).collect()
    assert got == streams.simulated(rows).collect() and {r.priority for r in got} <= {1, 2, 3, 4, 5} and len({r.id for r in got}) == 50
    assert streams.simulated_news(spark).isStreaming


def test_files(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("y = 1")
    (tmp_path / "src" / "r.md").write_text("# t\nbody")
    assert [r.source for r in files.read_sources(spark, str(tmp_path / "src")).collect()] == ["x = 1"]
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "src")).collect()] == ["# t\nbody"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("p/c.py", "z = 2")
        z.writestr("p/c.txt", "no")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    assert [r.source for r in files.read_archives(spark, str(tmp_path / "a.zip")).collect()] == ["z = 2"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0")
    assert [(r.media_type, r.width, r.height) for r in files.read_images(spark, str(tmp_path / "img")).collect()] == [("image/png", 640, 480)]
