"""Yinyang clustering against plain rounds over all distances."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def plain(rows, k=40, rounds=5, width=64):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x]))
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashed[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = nearest()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    near = nearest()
    by = {n: sum(d for d, m in near if m == n) for _, n in near}
    return sorted(((i is None, i or 0), n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near))


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(((r.vec_id is None, r.vec_id or 0), *tuple(r)[1:]) for r in yinyang.op13_query(spark, str(folder)).collect())


def test_query_equals_plain_rounds(spark, tmp_path):
    rng = random.Random(6)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in middles[i % 12]], 1, "x", 2) for i in range(300)]
    rows += [(1000 + i, [float(rng.randint(0, 1)) / 256 for _ in range(64)], None, None, None) for i in range(60)]  # many ties
    rows += [rows[3], rows[3], (3, rows[9][1], 1, None, 1), (None, rows[5][1], 1, "", 0), (None, middles[0], 1, "", 0)]
    rows += [(2000, None, 1, "", 0), (2001, [], 1, "", 0), (2002, [1.0] * 63, 1, "", 0), (2003, [1.0] * 65, 1, "", 0), (2004, [1.0] * 63 + [None], 1, "", 0),
             (2005, [math.nan] * 64, 1, "", 0), (2006, [math.inf] + [0.0] * 63, 1, "", 0), (2007, [-0.001] * 64, 1, "", 0), (2008, [1e4] * 64, 1, "", 0)]
    assert ran(spark, tmp_path, rows) == plain(rows)


def test_few_and_no_rows(spark, tmp_path):
    few = [(i, [float(i)] * 64, 1, "", 0) for i in range(5)]
    assert ran(spark, tmp_path / "few", few) == plain(few)
    assert ran(spark, tmp_path / "none", []) == []
    assert ran(spark, tmp_path / "ids", [(None, [1.0] * 64, 1, "", 0)]) == []
    with pytest.raises(Exception, match="too large"):
        ran(spark, tmp_path / "large", [(1, [1e30] * 64, 1, "", 0)])


def test_bounds_save_scans():
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (40, 64))
    x = middles[rng.integers(0, 40, 4000)] + rng.integers(-120, 120, (4000, 64))
    centroids, group = x[:40].copy(), yinyang.grouped(x[:40], 4)
    known = yinyang.Bounds(x, np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full((len(x), group.max() + 1), -np.inf))
    scanned = []
    for _ in range(8):
        known.scanned = 0
        known.assign(centroids, group)
        full = yinyang.squared(x, centroids)
        assert (known.cluster == full.argmin(1)).all()  # argmin: the first of equals
        for g in range(known.lower.shape[1]):
            others = np.where((group == g)[None, :] & (np.arange(40)[None, :] != known.cluster[:, None]), full, np.iinfo(np.int64).max).min(1)
            assert (known.lower[:, g] <= np.sqrt(others)).all()
        scanned.append(known.scanned)
        moved = np.stack([x[known.cluster == n].sum(0) // max(1, (known.cluster == n).sum()) if (known.cluster == n).any() else centroids[n] for n in range(40)])
        known.moved(np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + yinyang.MARGIN), group)
        centroids = moved
    assert scanned[-1] < 0.3 * scanned[0]


def test_other_widths(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    kept = yinyang.integers(spark.createDataFrame(rows, "key long, x array<double>"), "key", "x", width=2, scale=1)
    out, centroids = yinyang.cluster(kept, k=7, rounds=3, width=2)
    assert out.count() == 50 and centroids.shape == (7, 2)
    assert out.where(F.col("cluster").between(0, 6)).count() == 50
