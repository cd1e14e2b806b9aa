from __future__ import annotations

import itertools
import random

import pytest
from conftest import words

import corpus_pipeline
from siftstone.llm import nearcopies
from siftstone.llm.common import LAST_KEY


def grams(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """Brute force: the least (id, text) of each group linked at 0.8 or more."""
    sets, root = [grams(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        key = LAST_KEY if r[0] is None else r[0]
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values())


def edited(rows, seed=4):
    """Copies with 1 to 6 words changed, on both sides of the threshold, and chains."""
    rng, out = random.Random(seed), []
    for r in rows:
        w = words(r[1])
        for k in range(1, 7):
            if len(w) > 30:
                w = list(w)
                w[rng.randrange(len(w))] = f"new{rng.random()}"
                out.append((len(out) + 50_000, " ".join(w), r[2], r[3], 0))
    return out


def test_stage_keeps_one_of_each_group_of_near_copies(spark, docs, rows):
    both = list({repr(r[0]): r for r in [*rows, *edited(rows)] if r[0] is not None}.values())
    made = spark.createDataFrame(both, docs.schema).repartition(5)
    got = corpus_pipeline.near_duplicates(spark, made, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(both)


@pytest.mark.parametrize("leaders", [0, 1, 2])
def test_rounds_lose_no_link(spark, docs, rows, leaders, monkeypatch):
    monkeypatch.setattr(nearcopies, "LEADERS", leaders)
    both = [*rows, *edited(rows, 5)[:120]]
    got = nearcopies.keep_one(spark.createDataFrame(both, docs.schema).repartition(3))
    assert sorted(LAST_KEY if r.doc_id is None else r.doc_id for r in got.collect()) == kept(both)


def test_no_rows(spark, none):
    assert nearcopies.keep_one(none).count() == 0


def test_exploded_bands_are_not_broadcast(spark):
    """Some 32 rows a class look like one to the planner."""
    plans, keep = [], nearcopies.Store.keep

    class Seen(nearcopies.Store):
        def keep(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return keep(self, df)

    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(50)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(nearcopies, "Store", Seen)
        nearcopies.groups(docs).count()
    (banded,) = [p for p in plans if "explode(bands" in p and "bucket" in p and "count(1)" in p]
    assert "BroadcastHashJoin" not in banded and "SortMergeJoin" in banded
