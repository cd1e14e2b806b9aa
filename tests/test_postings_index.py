from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.operators import postings_index as p
from siftstone.operators import retrieval as r
from siftstone.operators.postings_index import PostingsIndex

COMMON = ["the", "of", "and", "in", "to"]


def made(n, seed=1, common=True):
    """Every document holds the commonest word; others thin out."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return [(i, " ".join((["the"] if common else []) + [rng.choice(COMMON) if rng.random() < 0.4 else words[min(399, int(rng.paretovariate(0.6)))] for _ in range(rng.randint(3, 60))])) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*made(900), (2000, None), (2001, ""), (2002, "The the THE")], "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, ["the", "w9"]), (2, ["w3", "w30", "of"]), (3, ["missing"]), (4, []), (5, ["w250", "the", "the"]), (6, ["to"])], "qid long, terms array<string>")


def rows(df):
    return sorted((x.qid, x["rank"], x.id, x.score, tuple(x.matched_terms)) for x in df.collect())


def plain(docs, questions, k):
    return sorted((q.qid, x["rank"], x.id, x.score, tuple(x.matched_terms)) for q in questions.collect() for x in r.bm25(docs, q.terms or ["-"], k).collect())


def test_search_equals_a_full_scan_after_changes(spark, tmp_path, docs, questions):
    index = PostingsIndex.build(docs.where("doc_id < 700"), str(tmp_path / "p"), docs_each=16)
    changed = spark.createDataFrame(made(60, seed=9, common=False), "doc_id long, text string")  # in place of 0 to 59
    index.upsert(docs.where("doc_id >= 700").union(changed))
    index.delete(docs.where("doc_id % 9 = 4").select(F.col("doc_id").alias("id")).union(spark.createDataFrame([(10**9,), (None,)], "id long")))
    index.upsert(docs.where("doc_id = 4"))  # deleted, then back
    now = docs.where("doc_id >= 60 and doc_id % 9 <> 4").union(changed.where("doc_id % 9 <> 4")).union(docs.where("doc_id = 4"))
    want = plain(now, questions, 7)
    assert rows(index.search(questions, 7)) == want
    index.compact(docs_each=50)
    index.segments.vacuum()
    assert rows(index.search(questions, 7)) == want
    assert rows(PostingsIndex(spark, str(tmp_path / "p")).search(questions, 7)) == want
    assert index.documents().count() == now.count()


def test_blocks_are_left_unread_and_common_words_stay_linear(spark, tmp_path, docs, questions):
    index = PostingsIndex.build(docs, str(tmp_path / "q"), docs_each=8)
    _, bounds, _, rest = index.plan(questions.where("qid in (1, 2)"), 3)
    every = bounds.agg(F.sum("blocks").alias("n")).first().n
    opened = rest.join(bounds, ["qid", "window"]).agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first().n
    assert opened + 6 * 3 < 0.6 * every
    plan = index._of(index.segments.read("postings", "term string, window long, seq long, part int"), questions.select(F.explode("terms").alias("term")))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.segments.read("postings", "term string, postings array<struct<id:long>>").agg(F.max(F.size("postings")).alias("m")).first().m < 40  # "the" is in every document


def test_empty_index(spark, tmp_path, docs, questions):
    index = PostingsIndex.build(docs.limit(0), str(tmp_path / "e"))
    assert index.search(questions, 3).count() == 0
    index.upsert(docs.where("doc_id < 50"))
    assert rows(index.search(questions, 3)) == plain(docs.where("doc_id < 50"), questions, 3)


def test_a_window_sends_on_no_more_than_the_best_of_each_question(spark, tmp_path, docs, questions, monkeypatch):
    monkeypatch.setattr(p, "ASKED", 2)  # questions are dealt into cells
    index = PostingsIndex.build(docs, str(tmp_path / "b"), docs_each=100)
    weighed, bounds, entries = index._bounded(questions)
    met = index._scored(weighed, bounds.select("qid", "window", F.lit(None).cast("double").alias("least")), entries, 3)
    assert met.count() <= 3 * bounds.count() < 0.2 * index._scored(weighed, bounds.select("qid", "window", F.lit(None).cast("double").alias("least")), entries, 10**6).count()
    want = plain(docs, questions, 3)
    assert rows(index.search(questions, 3)) == want
    monkeypatch.setattr(p, "LISTED", 1)  # terms by a join, not by a list
    assert rows(index.search(questions.union(questions), 3)) == want  # a question given twice counts once


def test_words_and_blocks_are_those_of_every_text(monkeypatch):
    monkeypatch.setattr(p, "TEXTS", 3)
    texts = ["", "one two one", "two", "9a ,b", "", "", "b\u00e9b b", ",,", "end", "x" * 300, "", "a"]
    batch = pa.record_batch({"id": pa.array(range(20, 8, -1), pa.int64()), "text": texts})
    for part in (batch, batch.slice(4), batch.slice(7, 1), batch.slice(0, 1)):
        found = pa.Table.from_batches(p._counted([part])).to_pylist()
        words = [re.findall("[a-z0-9]+", x) for x in part.column("text").to_pylist()]
        assert [x["id"] for x in found] == part.column("id").to_pylist()
        assert [(x["dl"], {y["term"]: y["tf"] for y in x["terms"]}, len(x["terms"])) for x in found] == [(len(w), {t: w.count(t) for t in w}, len(set(w))) for w in words]
    forward = pa.Table.from_batches(p._counted([batch])).combine_chunks().to_batches()[0]
    forward = forward.append_column("window", pa.array(np.arange(12) // 6, pa.int64()))
    blocks = [x for b in p._blocks([forward, forward.slice(0, 1)]) for x in b.to_pylist()]
    assert all(x["n"] == len(x["postings"]) and x["max_tf"] == max(y["tf"] for y in x["postings"]) and x["min_dl"] == min(y["dl"] for y in x["postings"]) for x in blocks)
    assert all([y["id"] for y in x["postings"]] == sorted(y["id"] for y in x["postings"]) for x in blocks)
    assert sorted((x["window"], y["id"], x["term"], y["tf"], y["dl"]) for x in blocks for y in x["postings"]) == sorted(
        (x["window"], x["id"], y["term"], y["tf"], x["dl"]) for x in forward.to_pylist() for y in x["terms"])


def test_scores_of_a_window_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(4)
    of = {t: sorted(rng.sample(range(40), 12)) for t in "abcdefg"}
    table = pa.table({"term": pa.array([*of, None]), "seq": pa.array([1] * 7 + [2], pa.int64()), "ids": pa.array([*of.values(), [3, 5]], pa.list_(pa.int64())),
                      "tfs": pa.array([[1 + i % 3 for i in v] for v in of.values()] + [[]], pa.list_(pa.int32())), "dls": pa.array([[9] * 12] * 7 + [[]], pa.list_(pa.int32()))})
    asked = pa.table({"qid": [1, 2], "least": pa.array([None, 1.0], pa.float64()), "avgdl": [9.0, 9.0], "terms": [["g", "a", "zz"], ["b", "c", "a"]], "idfs": [[1.0, 2.0, 3.0], [0.5, 0.25, 1.5]]})
    want = []
    for qid, least, weights in ((1, 0, {"g": 1.0, "a": 2.0}), (2, 1.0, {"b": 0.5, "c": 0.25, "a": 1.5})):
        for i in set(range(40)) - {3, 5}:
            score = sum(w * (1 + i % 3) * 2.5 / ((1 + i % 3) + 1.5) for t, w in weights.items() if i in of[t])
            if score > 0 and score >= least:
                want.append((qid, i, round(score, 6), sorted(t for t in weights if i in of[t])))
    for size in (1000, 7, 2):
        monkeypatch.setattr(p, "ROWS", size)
        monkeypatch.setattr(p, "TERMS", size)
        found = [(x["qid"], x["id"], round(x["score"], 6), x["matched_terms"]) for x in p._met(table, asked, 40).to_pylist()]
        assert sorted(found) == sorted(want)
