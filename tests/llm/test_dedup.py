from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from conftest import made_documents, words  # noqa: F401
from pyspark.sql import functions as F

from siftstone.llm import components, simhash, substring, textbatch
from siftstone.llm.common import LAST_KEY, Store


def removed(rows, window):
    """Brute force: what is kept of each row."""
    first = {}
    key = lambda i: LAST_KEY if i is None else i
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, LAST_KEY), key(r[0]))
    out = []
    for r in rows:
        w = words(r[1])
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(r[0]):
                drop[i : i + window] = [True] * window
        out.append((r[0], len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,anchor", [(13, 7), (5, 3), (8, 6)])
def test_substring_dedup_is_exact(docs, rows, window, anchor):
    got = substring.remove_duplicate_spans(docs, window=window, anchor=anchor)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr)
    assert found == removed(rows, window)
    assert got.columns[:5] == docs.columns


@pytest.mark.parametrize("seed", [2, 3])
def test_substring_dedup_on_small_vocabulary(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))), None, None, 0) for i in rng.sample(range(500), 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = substring.remove_duplicate_spans(df, window=5, anchor=3)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr) == removed(rows, 5)


def test_substring_dedup_edges(spark, none):
    assert substring.remove_duplicate_spans(none).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f", 5, 7), (2, "x a b c d e f", 5, 7)], "doc_id long, text string, ROW_KEY int, found int")
    got = {r.doc_id: r for r in substring.remove_duplicate_spans(clash, window=5, anchor=3).collect()}
    assert got[2].kept_text == "x" and got[2].found == 7 and got[2].duplicate_spans[0].start == 1
    with pytest.raises(ValueError):
        substring.remove_duplicate_spans(clash, window=13, anchor=3)


def found_by(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_duplicate_spans(df, **options).collect()), key=repr)


def test_words_that_differ_in_a_pattern_are_told_apart(spark):
    # Thue-Morse words defeat polynomials modulo 2**64.
    bits = lambda n: [i.bit_count() % 2 for i in range(n)]
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = []
    for n in (8, 16, 32, 64, 1024, 2048, 4096):
        for flip in (0, 1):
            rows.append((len(rows), f"{twelve} {''.join('ab'[b ^ flip] for b in bits(n))}"))
    assert found_by(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows, 13)
    w = textbatch.Words(pa.array([" ".join(r[1].split()[-1] for r in rows), "a ab abc aaaaaaaa aaaaaaaaa a\x00 a"]))
    for which in (0, 1):
        h = w.hashes(which)
        assert len(set(h.tolist())) == len(h) - 1 and h[-1] == h[len(rows)]


def test_repeated_rows_and_hot_passages(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda k: " ".join(f"v{rng.randrange(300)}" for _ in range(k))
    hot = text(40)
    rows = [(7, hot + " " + text(20), 0)] * 500 + [(None, hot, 0)] * 300
    rows += [(i, f"{text(rng.randint(0, 9))} {hot if i % 3 else hot[:90]} {text(rng.randint(0, 30))}", 0) for i in rng.sample(range(10, 2000), 400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, found int")
    assert found_by(df.repartition(3)) == removed(rows, 13)
    # Many batches in a task, whose table of met hashes is too small for them.
    few = substring.Met
    for bits in (17, 4):
        got = []
        monkeypatch.setattr(substring, "Met", lambda width, bits=bits: few(width, bits))
        monkeypatch.setattr(substring, "chunks", lambda batch, text: textbatch.chunks(batch, text, 600))
        table = pa.table({"text": [r[1] for r in rows], "key": [LAST_KEY if r[0] is None else r[0] for r in rows], "version": [hash(r[1]) for r in rows]})
        asked = list(substring._index("text", "key", "version", 4, 13, 7)(iter(table.to_batches())))
        asks = sum(n for b in asked for n in b.column(1).to_pylist() if n > 0)
        answers = {}
        for b in range(4):
            part = [x.filter(pa.compute.equal(x.column(0), b)) for x in asked]
            for r in substring._answer_anchors(pa.Table.from_batches(part)).to_pylist():
                answers.setdefault((r["key"], r["version"]), set()).add((r["place"], r["ref"], r["ref_place"]))
        found = pa.array([[dict(zip(("place", "ref", "ref_place"), a)) for a in sorted(answers.get((k, v), ()))] for k, v in zip(table["key"].to_pylist(), table["version"].to_pylist())], pa.list_(pa.struct([("place", pa.int32()), ("ref", pa.int64()), ("ref_place", pa.int32())])))
        runs = list(substring._factor("text", "key", "version", "found", 4, 13, 7)(iter(table.append_column("found", found).to_batches())))
        for b in range(4):
            part = [x.filter(pa.compute.equal(x.column(0), b)) for x in runs]
            got += substring._answer_runs(13)(pa.Table.from_batches(part)).to_pylist()
        cut = {}
        for r in got:
            cut.setdefault((r["key"], r["version"]), set()).update(range(r["start"], r["stop"]))
        kept = sorted(((r[0], len(words(r[1])), len(cut.get((LAST_KEY if r[0] is None else r[0], hash(r[1])), ())), " ".join(w for i, w in enumerate(words(r[1])) if i not in cut.get((LAST_KEY if r[0] is None else r[0], hash(r[1])), ()))) for r in rows), key=repr)
        assert kept == removed(rows, 13)
        if bits == 17:
            once = asks
    assert once < asks


def test_op2_query_equals_its_sql(spark, rows, tmp_path):
    import duckdb

    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = substring.op2_query(spark, str(tmp_path))
    cur = con.execute(substring.OP2_SQL)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in got.collect()} == {(i, n, hashlib.sha256(t.encode()).hexdigest()) for i, _, n, t in removed(unique, 13)}


def print_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x.encode() if isinstance(x, str) else x for x in low.split()]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(grams))


def linked(prints, distance=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash_clusters_match_brute_force(docs, rows):
    got = simhash.clusters(docs)
    prints = [print_of(r[1]) for r in rows]
    groups = linked(prints)
    least = {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    expected = sorted(((r[0], p, least.get(g)) for r, p, g in zip(rows, prints, groups)), key=repr)
    assert sorted(((r.id, r.fp & (2**64 - 1), r.component_id) for r in got.collect()), key=repr) == expected


def test_covering_code_misses_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype=np.int64)
    found = set(base.tolist())
    for x in base.tolist():
        for _ in range(8):
            y = x
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                y ^= 1 << b
            found.add(y if y < 2**63 else y - 2**64)
    prints = sorted(found)
    for blocks in (1, 2):
        pairs = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), blocks=blocks).collect()}
        brute = {(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
        assert pairs == brute
    code = simhash.Anchors(2, 1)
    i, _ = code.near(np.arange(2000, dtype=np.uint64), 0)
    assert len(i) == 2000  # the Golay code is perfect: one home for every word


def test_keep_one_of_each_group(spark, docs, rows, none):
    kept = simhash.keep_one(docs).collect()
    groups = linked([print_of(r[1]) for r in rows])
    assert len(kept) == len(set(groups)) and kept[0].__fields__ == docs.columns
    assert simhash.keep_one(none).count() == 0
    nulls = spark.createDataFrame([(None, "one two three four"), (None, "five six seven eight nine"), (None, "one two three four")], "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 2


def test_components_of_a_path_and_a_star(spark):
    store = Store(spark)
    path = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    random.Random(1).shuffle(path)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long"), store).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{k: 100 for k in range(101, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), store).count() == 0


def test_replicas_are_not_broadcast(spark):
    """Stored fingerprints look small to the planner; their replicas are some 60 times as many."""
    prints = Store(spark).keep(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    plan = simhash.near_pairs(prints)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
