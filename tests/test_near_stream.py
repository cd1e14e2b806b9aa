from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftstone.operators import dedup
from siftstone.streaming import near

START = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, content string"


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", near.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def made(n=60, seed=3):
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(5000)}"
    for i in range(n):
        base = rows[rng.randrange(len(rows))][2].split() if rows and rng.random() < 0.5 else [word() for _ in range(60)]
        if rng.random() < 0.6:
            base = [*base[:-1], word()]
        rows.append((i, START + timedelta(hours=i), " ".join(base)))
    return rows


def by_rule(spark, rows, hours, threshold=0.8):
    """All pairs that share a band, the earliest within the time."""
    at = {i: t for i, t, _ in rows}
    signed = {r.id: r.signature for r in dedup.signatures(spark.createDataFrame(rows, SCHEMA), "id", "content").collect()}
    out = {}
    for n, a in signed.items():
        for o, b in sorted(signed.items(), key=lambda x: at[x[0]]):
            same = sum(x == y for x, y in zip(a, b)) / len(a)
            bands = any(a[k : k + 8] == b[k : k + 8] for k in range(0, 128, 8))
            if (at[o], o) < (at[n], n) and at[n] - at[o] <= timedelta(hours=hours) and bands and same >= threshold:
                out[n] = (o, math.floor(same * 1e6 + 0.5) / 1e6)
                break
    return out


def test_batch_twin_equals_the_rule(spark, store):
    rows = made()
    got = near.first_matches(near.near_matches(spark.createDataFrame(rows, SCHEMA).repartition(3), "12 hours")).collect()
    want = by_rule(spark, rows, 12)
    assert {r.id: (r.duplicate_of, r.similarity) for r in got} == want and len(want) > 5
    assert len(want) < len(by_rule(spark, rows, 1000))


def test_stream_equals_the_rule_and_forgets(spark, store, tmp_path):
    rows = made(40)
    order = [*rows[:12], rows[14], *rows[12:14], *rows[15:40]]  # one early bird: two items come late
    later = [(1000 + i, START + timedelta(days=30 + i), f"alone {i} " + " ".join(f"x{i}y{j}" for j in range(40))) for i in range(3)]
    chunks = [order[:13], order[13:26], order[26:], *[[x] for x in later]]
    for n, some in enumerate(chunks):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    matches = near.near_matches(stream, "12 hours", delay="4 hours")
    query = matches.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {r.id: (r.duplicate_of, r.similarity) for r in near.first_matches(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == by_rule(spark, rows, 12)
    assert held[-1] < max(held) / 4, held  # what is past is gone from the state


def test_tables_need_no_state_store(spark):
    """The table's rule at edges of slices, with copies, equal times and times before 1970."""
    rng = random.Random(5)
    rows = [(i, START + timedelta(hours=h), text) for i, h, text in ((i, rng.choice([i, i - i % 4]), text) for i, _, text in made(90, 8))]
    rows += [(500 + i, datetime(1969, 12, 28) + timedelta(hours=7 * i), rows[i % 5][2]) for i in range(30)]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        for hours in (1, 5, 14, 70):
            found = near.near_matches(spark.createDataFrame(rows, SCHEMA).repartition(5), f"{hours} hours")
            assert {r.id: (r.duplicate_of, r.similarity) for r in near.first_matches(found).collect()} == by_rule(spark, rows, hours)
            assert "TransformWithState" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    none = near.near_matches(spark.createDataFrame([(1, None, "a b c"), (None, START, "a b c")], SCHEMA), "1 hour")
    assert none.count() == 0 and [f"{n} {t}" for n, t in none.dtypes] == [x.replace(" long", " bigint") for x in near.MATCH.split(", ")]
