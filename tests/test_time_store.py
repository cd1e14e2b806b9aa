from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators.time_store import TimeStore, day_number

UTC = datetime.UTC
SCHEMA = "id long, ts timestamp, kind string"


def at(day, hour=0, micro=0):
    return datetime.datetime(2024, 1, 1, tzinfo=UTC) + datetime.timedelta(days=day, hours=hour, microseconds=micro)


def made(n, seed, days=(0, 10)):
    rng = random.Random(seed)
    rows = [(seed * 1000 + i, at(rng.randrange(*days), rng.randrange(24), rng.randrange(10**6)), rng.choice("abc")) for i in range(n)]
    return [*rows, rows[0], (seed * 1000 + n, None, "untimed"), (seed * 1000 + n + 1, at(days[0]), None)]


def stored(df):
    return sorted((r.id, r.kind or "") for r in df.collect())


def plain(rows, start=None, end=None):
    return sorted((i, k or "") for i, t, k in rows if start is None or (t is not None and start <= t <= end))


@pytest.fixture
def store(spark, tmp_path):
    return TimeStore.create(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema)


def test_late_rows_compaction_and_expiry(spark, store):
    on_time, late, ancient = made(80, 1, (4, 10)), made(30, 2, (3, 6)), made(5, 3, (-4000, -3990))
    assert store.rows().count() == 0 and store.newest(3).count() == 0 and store.compact() == []
    for part in (on_time, late, ancient):
        store.append(spark.createDataFrame(part, SCHEMA).select("kind", "ts", "id"))
    every = on_time + late + ancient
    assert stored(store.rows()) == plain(every)
    ranges = [(at(3), at(5)), (at(4, 7), at(4, 7)), (at(5, 23, 500_000), at(8, 1)), (at(8), at(2)), (at(-5000), at(-3995))]
    for a, b in ranges:
        assert stored(store.in_range(a, b)) == plain(every, a, b)
    timed = sorted(((t, i, k) for i, t, k in every if t), key=lambda x: (x[0], x[1]), reverse=True)
    assert [r.id for r in store.newest(15).collect()] == [i for _, i, _ in timed[:15]]
    before = store.pairs()
    merged = store.compact()
    assert merged and len(store.pairs()) < len(before) and len({d for _, d, _ in store.pairs()}) == len(store.pairs())
    assert {p for p in before if p[1] not in merged} <= set(store.pairs())  # other days are not written again
    assert stored(store.rows()) == plain(every)
    store.expire(at(4, 12))
    kept = [r for r in every if r[1] is None or r[1] >= at(4)]
    assert stored(store.rows()) == plain(kept)
    assert store.vacuum() > 0 and stored(store.rows()) == plain(kept)
    again = TimeStore(spark, store.segments.path)
    assert len(again.segments.log()) == 1 and stored(again.rows()) == plain(kept) and again.vacuum() == 0
    again.append(spark.createDataFrame(late, SCHEMA))  # later than the expiry: seen until the next
    assert stored(again.in_range(at(3), at(6))) == plain(kept + late, at(3), at(6))


def test_days_are_pruned_and_do_not_follow_the_session(spark, store):
    rows = made(60, 5)
    store.append(spark.createDataFrame(rows, SCHEMA))
    found = store.in_range(at(2, 5), at(3, 5))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "utc_day" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(ts)" in plan
    assert all(f"utc_day={day_number(at(d))}" in " ".join(found.inputFiles()) for d in (2, 3)) and len({f.split("utc_day=")[1].split("/")[0] for f in found.inputFiles()}) == 2
    want = stored(found)
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert stored(store.in_range(at(2, 5), at(3, 5))) == want == plain(rows, at(2, 5), at(3, 5))
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_a_failed_append_leaves_nothing(spark, store):
    rows = made(20, 6)
    store.append(spark.createDataFrame(rows, SCHEMA))
    bad = spark.createDataFrame(made(20, 7), SCHEMA).withColumn("kind", F.when(F.col("id") == 7003, F.raise_error(F.lit("broken"))).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="broken"):
        store.append(bad)
    assert stored(store.rows()) == plain(rows)
    store.vacuum()
    assert stored(store.rows()) == plain(rows)


def test_another_writer_is_noticed(spark, store):
    entry = store.segments.begin("expire") | {"before": 0}
    store.append(spark.createDataFrame(made(3, 8), SCHEMA))
    with pytest.raises(RuntimeError, match="another writer"):
        store.segments.commit(entry)


def test_clashing_names(spark, tmp_path):
    with pytest.raises(ValueError, match="none named"):
        TimeStore.create(spark, str(tmp_path / "c"), spark.createDataFrame([], "ts timestamp, UTC_DAY int").schema)
