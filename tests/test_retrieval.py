from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import times, vectors
from siftstone.operators import dedup, graph, learned, retrieval as r, timeindex


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist()) for i in range(120)] + [(500, [0.0] * 8), (501, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)


def test_knn_is_exact_and_ties_go_by_id(spark, vecs):
    rows = {x.id: np.array(x.embedding or [0] * 8, float) for x in vecs.collect()}
    got = r.knn(vecs.where("id % 50 = 0 and id < 200").select(F.col("id").alias("qid"), "embedding"), vecs, 7, keep_self=False).collect()
    for q in (0, 50, 100):
        score = {i: round(float(rows[q] @ v / (np.linalg.norm(rows[q]) * np.linalg.norm(v) or 1)), 6) for i, v in rows.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:7]
        assert [x.id for x in sorted((x for x in got if x.qid == q), key=lambda x: x["rank"])] == best
    assert r.knn(vecs.limit(0).select(F.col("id").alias("qid"), "embedding"), vecs, 3).count() == 0


def test_lsh_finds_most_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 64))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(64)).astype("float32").tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    exact = {(x.qid, x.id) for x in r.knn(q, df, 10).collect()}
    near = {(x.qid, x.id) for x in r.lsh_knn(q, df, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_lsh_scores_within_its_buckets_and_takes_equal_rows_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    once, twice = (r.lsh_knn(q, x, 5, keep_self=False) for x in (df, df.unionByName(df)))
    assert sorted(once.collect()) == sorted(twice.collect())
    # No row for each pair of a bucket leaves it.
    assert "CoGroupsInArrow" in once._jdf.queryExecution().executedPlan().toString()


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0], 1 / math.sqrt(2)), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    for x in spark.createDataFrame(rows, "a array<double>, b array<double>, e double").withColumn("c", vectors.cosine(F.col("a"), F.col("b"))).collect():
        assert x.c == pytest.approx(x.e)


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog dog dog"), (3, "bird"), (4, None)], "doc_id long, text string")
    got = r.bm25(docs, ["cat", "dog"], 5).collect()
    assert [x.id for x in got] == [1, 2] and got[0].matched_terms == ["cat", "dog"]
    assert [x.id for x in r.tfidf(docs, ["bird"], 5).collect()] == [3]


def hits_of(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, score double, rank int")


def test_fusion(spark):
    hits = hits_of(spark, [(1, "vector", 0.9, 1), (2, "vector", 0.5, 2), (2, "sparse", 3.0, 1), (3, "sparse", 3.0, 2), (3, "graph", -1.0, 1)])
    rrf = {x.id: x for x in r.rrf(hits, 10).collect()}
    assert rrf[2].score == round(1 / 62 + 1 / 61, 6) and rrf[2].sources == ["sparse", "vector"] and rrf[2]["rank"] == 1
    weighted = {x.id: x.score for x in r.weighted(hits, {"vector": 0.5, "sparse": 0.3, "graph": 0.2}, 10).collect()}
    assert weighted == {1: 0.5, 2: 0.3, 3: 0.5}  # equal scores all count 1
    f = {x.id: x for x in r.fusion_features(hits).collect()}
    assert (f[2].f0, f[2].f1, f[2].f2, f[2].f3, f[2].f4, f[2].f9, f[2].f10, f[2].f11, f[2].f13, f[2].f14) == (0.5, 3.0, 0.0, 0.5, 1.0, 2.0, -2.5, 0.0, 3.0, 1.75)
    assert r.ranked(hits.where("source = 'vector'").select("id", "score").union(spark.createDataFrame([(2, 0.95)], "id long, score double")), "vector").where("id = 2").first()["rank"] == 1
    sides = {x.id: x.side for x in r.compare(hits.where("source = 'vector'"), hits.where("source = 'sparse'")).collect()}
    assert sides == {1: "only_a", 2: "both", 3: "only_b"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(range(6)))
def test_rrf_ignores_the_order_of_rows(spark, order):
    rows = [(i % 4, "vector" if i < 3 else "sparse", 1.0, i % 3 + 1) for i in range(6)]
    base = r.rrf(hits_of(spark, rows), 4).collect()
    assert r.rrf(hits_of(spark, [rows[i] for i in order]), 4).collect() == base


def test_learned_fusion_ranks_by_relevance(spark):
    rng = random.Random(0)
    rows = [(i, "vector", rng.random() + (0.8 if i % 2 else 0), i + 1) for i in range(60)]
    hits = hits_of(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, label int")
    for kind in ("gbt", "mlp"):
        model = learned.train(r.fusion_features(hits), labels, kind)
        best = learned.fuse(model, r.fusion_features(hits), hits, 10).collect()
        assert sum(x.id % 2 for x in best) >= 8
    assert learned.train(r.fusion_features(hits), labels.where("label = 1")) is None
    assert learned.fuse(None, None, hits, 3).count() == 3


def exact_signature(text, n=3):
    import hashlib

    w = text.lower().split()
    shingles = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    h = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in shingles]
    return [min((a * x + b) % dedup.PRIME for x in h) for a, b in dedup.multipliers()] if h else None


def test_minhash_signatures_and_matches(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [(1, base), (2, base), (3, base + " seventeen"), (4, "something quite different from all the others here now"), (5, "two words"), (6, None), (7, base + " seventeen")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.id: x.signature for x in dedup.signatures(df).collect()}
    assert set(got) == {1, 2, 3, 4, 7} and all(got[i] == exact_signature(t) for i, t in texts if i in got)
    match = {x.id: (x.duplicate_of, x.similarity) for x in dedup.first_match(df).collect()}
    assert match[2] == (1, 1.0) and match[7] == (3, 1.0) and match[3][0] == 1 and match[3][1] >= 0.8 and set(match) == {2, 3, 7}


def test_least_of_shingles_at_the_ends_of_the_prime():
    # One fold and one subtraction reach every remainder, also where a * x + b is a multiple of the prime.
    p = dedup.PRIME
    xs = [0, 1, 2, p // 2, p - 2, p - 1]
    pairs = [(1, 0), (1, 1), (1, p - 1), (p - 1, 0), (p - 1, p - 1), (2, 1), (p // 2, p - 2)]
    got = dedup._least(np.array(xs, np.uint64), np.arange(len(xs)), pairs)
    assert got.tolist() == [[(a * x + b) % p for a, b in pairs] for x in xs]
    assert dedup._least(np.array(xs, np.uint64), np.array([0, 4]), pairs).tolist() == [[min((a * x + b) % p for x in part) for a, b in pairs] for part in (xs[:4], xs[4:])]
    grams = [b"a b c", "\u00e9 \u4e16 z".encode()]
    assert dedup._hashes(grams).tolist() == [int(hashlib.md5(g).hexdigest(), 16) % p for g in grams]


def test_signature_similarity_estimates_jaccard(spark):
    rng = random.Random(5)
    a = [f"w{rng.randrange(1000)}" for _ in range(200)]
    b = a[:150] + [f"v{i}" for i in range(50)]
    sig = {x.id: x.signature for x in dedup.signatures(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(sum(x == y for x, y in zip(sig[1], sig[2])) / 128 - true) < 0.15


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"intro {item} outro"), (2, "nothing of that kind in this text at all, sorry")], "doc_id long, text string")
    got = dedup.contamination(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x.item_id, x.id, x.share) for x in got] == [(9, 1, 1.0)]


AS_OF = "2024-01-31 00:00:00"


@pytest.mark.parametrize("ago,exponential,note", [(0, 1.0, "Based on data from the last minute"), (59, 1.0, "Based on data from the last minute"), (3600, 1.0, "As of 1 hour ago"), (3601, math.exp(-math.log(2) / 24 * 3601 / 3600), "As of 1 hour ago"),
                                                   (86400, 0.5, "As of 2024-01-30 00:00 UTC"), (-7200, 1.0, "Based on data from the last minute"), (120, 1.0, "As of 2 minutes ago")])
def test_decay_and_freshness(spark, ago, exponential, note):
    as_of = F.lit(AS_OF).cast("timestamp")
    ts = F.timestamp_micros(F.unix_micros(as_of) - F.lit(ago * 1_000_000))
    x = spark.range(1).select(times.time_score(ts, as_of).alias("e"), times.time_score(ts, as_of, "other").alias("o"), times.freshness(ts, as_of).alias("n"), times.time_score(ts, as_of, "logarithmic").alias("l")).first()
    assert x.e == pytest.approx(exponential) and x.o == 1.0 and x.n == note and 0 < x.l <= 1


def test_decay_is_monotone(spark):
    as_of = F.lit(AS_OF).cast("timestamp")
    rows = spark.range(2, 900, 7).select("id", *(times.time_score(F.timestamp_micros(F.unix_micros(as_of) - F.col("id") * 3_600_000_000), as_of, k).alias(k) for k in ("exponential", "linear", "logarithmic"))).orderBy("id").collect()
    for kind in ("exponential", "linear", "logarithmic"):
        values = [x[kind] for x in rows]
        assert values == sorted(values, reverse=True) and values[-1] >= 0


def test_clock_and_label(spark):
    ts = F.lit("2024-02-29 13:05:09").cast("timestamp")
    got = spark.range(1).select(times.clock("now", ts, "Europe/Berlin").alias("now"), times.clock("weekday", ts).alias("day"), times.freshness_label(ts, F.lit("2024-03-02 13:05:09").cast("timestamp")).alias("label")).first()
    assert tuple(got) == ("2024-02-29 14:05:09", "Thursday", "2 days ago")
    with pytest.raises(ValueError):
        times.clock("year", ts)


def test_time_weighted_search_filters_first(spark):
    rows = [(i, f"2024-01-{30 - i:02d} 00:00:00", "error" if i % 2 else "view", "s", 0.5, 3, False) for i in range(20)]
    items = spark.createDataFrame(rows, "id long, ts string, kind string, source string, similarity double, priority int, is_duplicate boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    as_of = F.lit(AS_OF).cast("timestamp")
    chosen = timeindex.select_items(items, kinds=("error",), sources=("s",), since=F.lit("2024-01-15").cast("timestamp"), duplicates=False)
    assert [x.id for x in timeindex.time_weighted(chosen, as_of, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert timeindex.in_range(items, F.lit("2024-01-29").cast("timestamp"), F.lit("2024-01-30").cast("timestamp")).count() == 2


def brute_paths(edges, a, depth):
    best, frontier, seen = {}, [(a,)], {a}
    for _ in range(depth):
        step = sorted(p + (t,) for p in frontier for s, t in edges if s == p[-1])
        frontier = []
        for p in step:
            if p[-1] not in seen and p[-1] not in {q[-1] for q in frontier}:
                frontier.append(p)
        seen |= {p[-1] for p in frontier}
        best |= {p[-1]: p for p in frontier}
    return best


def test_graph_walks(spark):
    rng = random.Random(2)
    edges = sorted({(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(26)})
    df = spark.createDataFrame([(s, t, "calls", 0.5) for s, t in edges], "source string, target string, type string, weight double")
    one = spark.createDataFrame([("n00",)], "id string")
    goal = spark.createDataFrame([(f"n{i:02d}",) for i in range(14)], "id string")
    got = {x.id: tuple(x.path) for x in graph.shortest_paths(df, one, goal).collect()}
    assert got == {k: v for k, v in brute_paths(edges, "n00", 10).items() if k != "n00"}
    both = edges + [(t, s) for s, t in edges]
    near = {x.id: x.distance for x in graph.within(df, one, 2).collect()}
    assert near == {k: len(v) - 1 for k, v in brute_paths(both, "n00", 2).items() if k != "n00"}
    chains = {tuple(x.path) for x in graph.chains(df, one, 3).collect()}

    def simple(p, d):
        return {p} | (set().union(*[simple(p + (t,), d - 1) for s, t in edges if s == p[-1] and t not in p]) if d and any(s == p[-1] for s, _ in edges) else set())

    assert chains == simple(("n00",), 3)
    named = spark.createDataFrame([("n00", "Alpha"), ("n01", "Alpha Two"), ("n02", "beta"), ("n03", "alpha"), ("n04", "alpha")], "id string, name string")
    q = spark.createDataFrame([(1, "What of ALPHA two?"), (2, "none")], "qid long, question string")
    assert sorted((x.qid, x.id) for x in graph.named_in(q, named).collect()) == [(1, "n00"), (1, "n01"), (1, "n03")]
    other = spark.createDataFrame([("e1", "Émile"), ("e2", "two"), ("e3", "日本"), ("e4", ""), ("e5", "x")], "id string, name string")
    asked = spark.createDataFrame([(1, "Did émile see network in 日本語?"), (2, "É"), (3, None), (4, "")], "qid long, question string")
    assert sorted((x.qid, x.id) for x in graph.named_in(asked, other).collect()) == [(1, "e1"), (1, "e2"), (1, "e3")]


def test_many_queries_meet_the_corpus_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(90)] + [(200, None), (201, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.select(F.col("id").alias("qid"), "embedding")
    few = sorted(map(tuple, r.knn(q, df, 6, keep_self=False).collect()))
    monkeypatch.setattr(r, "BLOCK", 20)
    monkeypatch.setattr(r, "CELL", 25)
    assert sorted(map(tuple, r.knn(q, df, 6, keep_self=False).collect())) == few and len(few) == 91 * 6


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "384 wide"])
def test_approximate_search_finds_the_neighbours_at_every_size(spark, size):
    from pathlib import Path

    where = Path(f"/root/testdata/{size}/embeddings.parquet")
    if size == "384 wide":
        rng = np.random.default_rng(1)
        x = rng.standard_normal((40, 384))[rng.integers(0, 40, 1000)] + 0.5 * rng.standard_normal((1000, 384))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    elif where.exists():
        df = spark.read.parquet(str(where)).select(F.col("vec_id").alias("id"), "embedding")
    else:
        pytest.skip("no such table here")
    q = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    exact = {(x.qid, x.id) for x in r.knn(q, df, 5, keep_self=False).collect()}
    near = {(x.qid, x.id) for x in r.lsh_knn(q, df, 5, keep_self=False).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_bucket_codes_grow_with_the_rows():
    assert r.lsh_bits(10) == 8 and r.lsh_bits(10**9) == 21 and r.lsh_bits(10**12) == 31


def test_crowded_buckets_are_split(spark, monkeypatch):
    rows = [(i, [i % 3, 5, 5, 5]) for i in range(40)]
    sets = spark.createDataFrame(rows, "class_id long, signature array<long>")
    monkeypatch.setattr(dedup, "PART", 4)
    got = {tuple(x) for x in dedup.candidates(sets, bands=2, rows=2).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    got = {tuple(x) for x in dedup.candidates(sets, bands=1, rows=2).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3}


def test_graph_tables(spark):
    v = spark.createDataFrame([("a", "A", "x"), ("b", "B", "y")], "id string, name string, type string")
    e = spark.createDataFrame([("a", "b", "t", 0.5)], "source string, target string, type string, weight double")
    assert [x.id for x in graph.find(v, "b").collect()] == ["b"] and graph.find(v, kind="x", id="b").count() == 0
    more = graph.with_vertices(v, spark.createDataFrame([("b", "new", "y"), ("c", "C", "z")], "id string, name string, type string"))
    assert sorted((x.id, x.name) for x in more.collect()) == [("a", "A"), ("b", "new"), ("c", "C")]
    edges = graph.with_edges(e, spark.createDataFrame([("a", "b", "t", 0.9), ("a", "b", "u", 0.1)], e.schema))
    assert sorted((x.type, x.weight) for x in edges.collect()) == [("t", 0.9), ("u", 0.1)]
    nodes, links = graph.export_network(v, e)
    assert nodes.first().json == '{"id":"a","label":"A","group":"x"}' and links.first().json == '{"from":"a","to":"b","label":"t","value":0.5}'
    found = graph.entity_search(e, v.where("id = 'a'").select("id")).first()
    assert (found.id, found.score, found.path) == ("b", 0.25, ["a", "b"])
