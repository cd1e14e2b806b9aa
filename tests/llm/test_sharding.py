"""Sharding against a plain greedy search over all group sizes."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from conftest import SCHEMA

from siftstone.llm import sharding


def greedy(sizes, capacity, shards):
    cuts, at = [], 0
    for _ in range(shards):
        total, start = 0, at
        while at < len(sizes) and (at == start or total + sizes[at] <= capacity):
            total += sizes[at]
            at += 1
        cuts.append(at)
    return cuts if at == len(sizes) else None


def best(sizes, shards):
    low, high = 1, max(1, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid, shards) else (mid + 1, high)
    return low, greedy(sizes, low, shards)


def groups_of(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    key = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    return sorted(groups.values(), key=key)


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return sharding.op12_query(spark, str(folder)).collect()


@pytest.mark.parametrize("cells", [64, 400, 5000])
def test_capacity_equals_search_over_sizes(spark, cells):
    rng = random.Random(cells)
    for n, shards in ((300, 7), (40, 24), (5, 24), (1, 3), (900, 24)):
        sizes = [rng.choice([8, 9, rng.randint(8, 4000), 8 + rng.randint(0, 60)]) for _ in range(n)]
        if n > 100:
            sizes[n // 3] = sum(sizes) // 2  # a hot group
        total, ends = 0, []
        for s in sizes:
            total += s
            ends.append((total,))
        got, cuts = sharding.capacity(spark.createDataFrame(ends, "upto long"), total, shards, cells)
        want, _ = best(sizes, shards)
        assert got == want and len(cuts) == shards and cuts[-1] == total
        alone = {(e - s, e) for (e,), s in zip(ends, sizes)}
        assert all(a == b or {(0,)} | set(ends) >= {(a,), (b,)} and (b - a <= want or (a, b) in alone) for a, b in zip([0, *cuts], cuts))
        # No contiguous partition at all has a smaller largest shard.
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= max(want, max(sizes))


def test_evened_shards_are_near_equal(spark):
    rng = random.Random(4)
    sizes = [rng.randint(8, 400) for _ in range(4000)]
    sizes[2000] = sum(sizes) // 2
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    _, cuts = sharding.capacity(spark.createDataFrame([(e,) for e in ends], "upto long"), ends[-1])
    rest = sorted(b - a for a, b in zip([0, *cuts], cuts))[:-1]
    assert rest[0] > 0.9 * rest[-1]


def test_query(spark, tmp_path, rows):
    rng = random.Random(1)
    more = [*rows, *((2000 + i, "a hot text " * 30, "en", "a", 1) for i in range(150)), *((5000 + i, "x" * rng.randint(0, 900), "en", "a", 1) for i in range(100)), (None, "alone", "en", "a", 1), (None, None, "en", "a", 1), (9000, "é" * 200_000, "en", "a", 1)]
    out = ran(spark, tmp_path, more)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in more)
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    groups = groups_of(more)
    sizes = [sum(len((r[1] or "").encode()) + 8 for r in g) for g in groups]
    want, _ = best(sizes, 24)
    shard = defaultdict(set)
    for r in out:
        shard[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shard.values())  # equal texts stay together
    order = [min(shard[zlib.crc32((g[0][1] or "").encode())]) for g in groups]
    assert order == sorted(order)  # runs of groups
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) <= 23
    by_size = defaultdict(int)
    for r in out:
        by_size[r.shard] += r.size
    alone = {k for k in by_size if order.count(k) == 1}
    assert max(v for k, v in by_size.items() if k not in alone) <= want and len(by_size) == 24
    assert sorted(by_size.values())[4] > want / 2  # groups that stand between large ones apart


def test_query_equals_its_sql(spark, tmp_path, rows):
    import duckdb

    some = [*{r[0]: r for r in rows if r[0] is not None}.values(), *((2000 + i, "hot " * 300, "en", "a", 1) for i in range(150)), (5000, "é\U0001f600" * 500, "en", "a", 1)]
    out = ran(spark, tmp_path, some)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(sharding.OP12_SQL)
    names = [d[0] for d in got.description]
    assert sorted(tuple(r[n] for n in names[:-1]) for r in out) == sorted(r[:-1] for r in got.fetchall())


def test_empty_and_few_rows(spark, tmp_path):
    assert ran(spark, tmp_path / "none", []) == []
    few = ran(spark, tmp_path / "few", [(1, "a", None, None, 1), (2, "b", None, None, 1), (2, "b", None, None, 1)])
    assert sorted((r.doc_id, r.shard, r.slot) for r in few) == [(1, 0, 0), (2, 1, 0), (2, 1, 1)]


def test_columns_pass_through(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 9, 7, 5, 3), (2, "b", 8, 6, 4, 2), (3, "a", 0, 0, 0, 0)], "doc_id long, text string, SHARD int, shard_row int, upto int, `od.d` int")
    out = sharding.shard_documents(docs, shards=2)
    assert sorted(out.columns) == sorted(["doc_id", "text", "shard_row", "upto", "od.d", "size", "shard", "slot"])
    assert sorted((r.doc_id, r.shard, r.slot, r["od.d"]) for r in out.collect()) == [(1, 0, 0, 3), (2, 1, 0, 2), (3, 0, 1, 0)]
