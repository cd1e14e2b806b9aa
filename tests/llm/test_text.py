from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from siftstone.llm import chat, mixing, quality, spotsigs, toxicity

# --- chat formatting


def test_turns_and_mask_are_read_back():
    nasty = ["\\### Assistant: </turn> ok", "", "</turn>\n### x: y</turn>\n", "\\\\", "###", "a\\", " ", "<|x|>", "ends <", "\n"]
    turns = [("user" if i % 2 else "assistant", t) for i, t in enumerate(nasty)] + [("odd: role\\", "x"), ("", "")]
    formatted, spans, broken = chat.locate(chat.turn_template, turns)
    assert broken is None and formatted == chat.turn_template(turns) and chat.parse(formatted) == turns
    assert [chat.unescape(formatted[s[2] : s[3]]) for s in spans] == [t for _, t in turns]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(formatted)


def test_long_conversations():
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(197)]
    formatted, spans, broken = chat.locate(chat.turn_template, turns)
    assert broken is None and formatted == chat.turn_template(turns)
    assert [formatted[s[2] : s[3]] for s in spans] == [t for _, t in turns]


def test_templates_that_rewrite_history_are_found(spark):
    def counting(turns):
        return f"{len(turns)} turns\n" + chat.turn_template(turns)

    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t[:1]}\n" for i, (r, t) in enumerate(turns))

    turns = [("user", "hello"), ("assistant", "world"), ("user", "again")]
    assert chat.locate(counting, turns)[2] == 0
    assert chat.locate(last_only, turns)[2] == 1
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(df, last_only).first()
    assert row.rewritten_at == 1 and row.loss_spans == []


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (None, 1, "assistant", "y"), (2, 0, "assistant", "z"), (2, 0, "assistant", "z"), (2, None, "user", "first")]
    schema = "conv_id long, turn long, role string, text string"
    made = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    got = {r.conv_id: r for r in made if r.conv_id is not None}
    assert chat.parse(got[1].formatted) == [("user", ""), ("assistant", "b")]
    assert chat.parse(got[2].formatted) == [("user", "first"), ("assistant", "z"), ("assistant", "z")]
    alone = {r.formatted: len(r.loss_spans) for r in made if r.conv_id is None}
    assert {f: chat.parse(f) for f in alone} == {f: [("", "x")] if n == 0 else [("assistant", "y")] for f, n in alone.items()} and len(alone) == 2
    clash = spark.createDataFrame([(1, 0, "user", "q", 9, 9)], schema + ", turns long, formatted long")
    assert chat.parse(chat.format_conversations(clash).first().formatted) == [("user", "q")]
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


# --- quality rules


def counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_counts_match_brute_force(spark, docs, rows):
    extra = ["a b a b a b a b", "x\nx\n\n \nx", "☃ é # $ |", "one two", "a a a a a", "t\x0bu\x0cv\rw"]
    df = docs.unionByName(spark.createDataFrame([(5000 + i, t, "en", "a", 0) for i, t in enumerate(extra)], docs.schema))
    got = sorted(((r.doc_id, *(r[m] for m in quality.MEASURES[:6])) for r in quality.measure(df).collect()), key=repr)
    assert got == sorted([(r[0], *counts(r[1])) for r in rows] + [(5000 + i, *counts(t)) for i, t in enumerate(extra)], key=repr)


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 100, 1000, 50_000, 3_000_000) for k in (0, 1, 3, 40, 190, 2600, 11_700) if k <= n]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.004).alias("p")).collect()
    for r in got:
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.004) + (r.n - j) * math.log1p(-0.004)) for j in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.004 else exact, rel=1e-6)


def chosen(measured, labels, allowed=quality.ALLOWED, delta=quality.DELTA):
    """Brute force of the cutoffs: stratum to (n_good, level, cutoffs)."""
    quality_of = {}
    for d, q in labels:
        if d is not None and q is not None:
            quality_of[d] = min(q, quality_of.get(d, q))
    held = defaultdict(list)
    for r in measured:
        if not r.base_failed and r.doc_id in quality_of:
            held[r.lang].append((quality_of[r.doc_id] == 1, r))
    held = {s: rs for s, rs in held.items() if any(g for g, _ in rs)}
    out = {}
    good = sorted((-sum(g for g, _ in rs), s is not None, s or "") for s, rs in held.items())
    m = max((p for p, (n, *_) in enumerate(good, 1) if -n >= math.log(delta / p) / math.log1p(-allowed)), default=0)
    tested = {s if there else None for _, there, s in good[:m]}
    for s, rs in held.items():
        n, level = sum(g for g, _ in rs), -1
        for i in range(quality.LEVELS if s in tested else 0):
            k = sum(g and any(r[rule] > cuts[i] for rule, cuts in quality.CUTOFFS.items()) for g, r in rs)
            tail = 1.0 if k >= n * allowed else sum(math.comb(n, j) * allowed**j * (1 - allowed) ** (n - j) for j in range(k + 1))
            if tail > delta / m:
                break
            level = i
        cut = []
        for rule, cuts in quality.CUTOFFS.items():
            gain = [(sum((not g) - g for g, r in rs if r[rule] > c), -i) for i, c in enumerate(cuts[: level + 1])]
            best = max(gain, default=(0, 0))
            cut.append(cuts[-best[1]] if best[0] > 0 else None)
        out[s] = (n, level, *cut)
    return out


def labelled(n=2500, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.85
        body = [f"w{rng.randrange(10**6)}" + ("!" if rng.random() < 0.05 else "") for _ in range(rng.randint(45, 90))]
        junk = rng.random() * (0.03 if good else 0.6)
        body = [b + ("###" if rng.random() < junk else "") for b in body]
        if rng.random() < (0.004 if good else 0.4):
            body += body[:20]
        rows.append((i, " ".join(body), rng.choice(["en"] * 12 + ["de"] * 7 + [None])))
        labels.append((i, int(good)))
    return rows, [*labels, (None, 1), (3, None), (4, 0), (4, 1)]


def test_cutoffs_match_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rows, labels = labelled()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, marks = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    measured = quality.measure(docs).cache()
    got = {r[0]: tuple(r)[1:] for r in quality.choose_cutoffs(measured, marks).collect()}
    expected = chosen(measured.collect(), labels)
    assert got == expected and expected["en"][1] > 0 and expected[None][1] == -1 and any(expected["de"][2:])
    query = quality.op10_query(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(quality.OP10_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, query.select(names).collect())) == sorted(cur.fetchall()) and sorted(names) == sorted(query.columns)
    # The holdouts lose no more than the bound, and junk goes.
    kept = {r.doc_id: r.kept for r in query.collect()}
    failed = {r.doc_id for r in measured.collect() if r.base_failed}
    good, bad = ([i for i, q in labels[:2500] if q == x and i not in failed] for x in (1, 0))
    assert sum(not kept[i] for i in good) <= quality.ALLOWED * len(good) and sum(not kept[i] for i in bad) > 0.7 * len(bad)


@pytest.mark.parametrize("good, level", [((148, 60), False), ((149, 148), True), ((200, 180, 30), True)])
def test_delta_is_shared_by_the_strata_that_can_prove_something(spark, good, level):
    rows = [(1000 * s + i, " ".join(f"w{i}x{j}" for j in range(60)), f"l{s}") for s, n in enumerate(good) for i in range(n)]
    bad = [(1000 * s + 900 + i, " ".join(f"w{i}x{j}###" for j in range(60)), f"l{s}") for s in range(len(good)) for i in range(5)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = [(r[0], 1) for r in rows] + [(r[0], 0) for r in bad]
    measured = quality.measure(docs).cache()
    got = {r[0]: tuple(r)[1:] for r in quality.choose_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert got == chosen(measured.collect(), labels)
    # 149 good labels prove one stratum, 183 each of two.
    assert [got[f"l{s}"][1] >= 0 for s in range(len(good))] == [level, *[False] * (len(good) - 1)]


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        body = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if not good:
            body = [b + "###" for b in body]
        rows.append((i, " ".join(body), "en" if i < 5900 else "xx"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    measured = quality.measure(docs).cache()
    cut = {r.stratum: r for r in quality.choose_cutoffs(measured, marks).collect()}
    assert cut["en"].symbol_ratio_cutoff is not None and cut["xx"].symbol_ratio_cutoff is None
    kept = {r.doc_id: r.kept for r in quality.apply_rules(docs, marks).collect()}
    assert all(kept[i] for i, q in labels if q) and not any(kept[i] for i, q in labels if not q and i < 5900)
    assert all(kept[i] for i in range(5900, 6000))  # too few labels: nothing is rejected


def test_quality_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.apply_rules(docs, labels)
    assert kept.columns[:5] == docs.columns and kept.count() == len(rows)
    assert quality.apply_rules(none, labels).count() == 0
    clash = docs.select("doc_id", "text", "lang", F.lit(1).alias("kept"), F.lit(2).alias("STRATUM"), F.lit(3).alias("measured"))
    assert {r.STRATUM for r in quality.apply_rules(clash, labels).collect()} == {2}


# --- mixing


def shares(sizes, weights, most=3):
    """Reshare the excess until no target is above its cap."""
    target, open_ = {}, dict(sizes)
    left = sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level >= most * sizes[s]]
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_its_targets(docs, rows):
    got = mixing.plan_mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = shares(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == r.size * len(r.positions) <= 3 * r.size and sorted(r.positions) == r.positions and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= max(r.size for r in got if r.source == s)
    again = mixing.plan_mix(docs.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_training_order(spark, docs, none):
    plan = {repr(r.doc_id): r for r in mixing.plan_mix(docs).collect()}
    rows = mixing.mix(docs).collect()
    position = [r.position for r in rows]
    assert position == sorted(position) and rows[0].__fields__[:5] == docs.columns
    assert sum(len(words(r.text)) for r in rows) == sum(r.taken for r in mixing.plan_mix(docs).collect())
    assert len(plan) and mixing.mix(none).count() == 0
    # The demand curve: a rising schedule takes less than half of its words in the first half.
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    early = {r.source: r.n for r in mixing.mix(many).where("position <= 0.5").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    late = {r.source: r.n for r in mixing.mix(many).where("position > 0.5").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert early["0"] / late["0"] == pytest.approx(3 / 5, rel=0.05) and early["1"] / late["1"] == pytest.approx(5 / 3, rel=0.05)


def test_op8_query_equals_its_sql_and_the_order(spark, tmp_path, rows):
    import duckdb

    unique = list({r[0]: r for r in rows if r[0] is not None}.values()) + [(7000 + i, "", "en", "empty", 0) for i in range(30)]
    spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(mixing.OP8_SQL)
    names = [d[0] for d in cur.description]
    close = lambda x: tuple(round(v, 9) if isinstance(v, float) else v for v in x)
    assert sorted(map(close, got.select(names).collect()), key=repr) == sorted(map(close, cur.fetchall()), key=repr) and sorted(names) == sorted(got.columns)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    order = [r.doc_id for r in mixing.mix(docs).collect()]
    assert {r.doc_id: r.first_rank for r in got.collect()} == {d: order.index(d) if d in order else None for d, *_ in unique}
    # The stored table gives the order back.
    mixing.mix(docs, with_position=False).write.parquet(str(tmp_path / "mixed"))
    stored = spark.read.parquet(str(tmp_path / "mixed"))
    back = mixing.read_order(stored).collect()
    assert stored.columns == docs.columns and sorted(r["rank"] for r in back) == list(range(len(order)))
    assert [r.doc_id for r in sorted(back, key=lambda r: r["rank"])] == order
    assert len({r["rank"] for r in mixing.read_order(mixing.mix(docs)).collect()}) == len(order)


def test_mixing_edges(spark, none, tmp_path):
    clash = spark.createDataFrame([(1, "a b", "x", 1, 2, 3.0, 4, 5), (None, None, None, None, None, None, None, None), (2, "c", "x", 1, 1, 1.0, 1, 1), (2, "c", "x", 1, 1, 1.0, 1, 1)], "doc_id long, text string, source string, SIZE int, target int, position double, mixed int, mix_key int")
    got = mixing.mix(clash, with_position=False)
    assert got.columns == clash.columns and {r.SIZE for r in got.collect()} <= {1, None}
    assert sum(r.taken for r in mixing.plan_mix(clash).collect()) == sum(len(words(r.text)) for r in got.collect())
    assert mixing.mix(clash).columns == ["doc_id", "text", "source", "SIZE", "target", "mixed", "mix_key", "position"]
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.op8_query(spark, str(tmp_path)).count() == 0 and mixing.read_order(none).count() == 0


# --- SpotSigs


def spots(text):
    bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in words((text or "").lower())]
    w = [x for x in bare if x] or words((text or "").lower())
    common, chain, gap = set(spotsigs.ANCHORS), spotsigs.CHAIN, spotsigs.GAP
    content = [i for i, x in enumerate(w) if x not in common]
    found = set()
    for i, x in enumerate(w):
        if x in common:
            after = [w[j] for j in content if j > i][:chain]
            if len(after) == chain:
                found.add((x, *after))
        elif not any(y in common for y in w[max(0, i - gap) : i + 1]) and i + chain < len(w):
            found.add(tuple(w[i : i + chain + 1]))
    return found or {(x,) for x in w}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_signatures_match_brute_force(spark, docs, rows):
    extra = [(9000 + i, t, None, None, 0) for i, t in enumerate(["The cat sat on the mat near a big red house of stone", "!!! ??? ...", "one", "le chat est noir et la maison", "a the of"])]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {(r.doc_id, r.text): r for r in spotsigs.fingerprints(df).collect()}
    for r in [*rows, *extra]:
        g = got[(r[0], r[1])]
        assert len(g.signatures) == len(spots(r[1])) and len(g.fingerprint) == 8 * len(g.signatures), r


def test_similar_pairs_lose_no_link(spark, rows):
    base = [(i, r[1]) for i, r in enumerate(rows)]
    rng = random.Random(9)
    for i in range(20):
        w = words(rows[rng.randrange(50)][1])
        if len(w) > 40:
            w[rng.randrange(len(w))] = "changed"
            base.append((500 + i, " ".join(w)))
    pairs, members = spotsigs.similar_pairs(spark.createDataFrame(base, "doc_id long, text string"), threshold=0.8)
    class_of = {r.id: r.class_id for r in members.collect()}
    assert set(class_of) == {i for i, _ in base}
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    sets = {i: spots(t) for i, t in base}
    leads = sorted({class_of[i] for i, _ in base if sets[i]})
    brute = {(a, b) for k, a in enumerate(leads) for b in leads[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.8}
    assert found == brute and brute


def test_next_document(spark, docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = spotsigs.with_next(docs.withColumn("version", F.xxhash64("text")), "doc_id", ["doc_id"], F.col("version")).collect()
    following = {r.doc_id: r.next_doc_id for r in out if r.doc_id is not None}
    ids = [r[0] for r in order]
    assert len(out) == len(rows)
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        if a is not None and ids.count(a) == 1:
            assert following[a] == b
    assert sorted(repr(r.next_doc_id) for r in out) == sorted(map(repr, ids))
    assert spotsigs.with_next(none.withColumn("version", F.xxhash64("text")), "doc_id", ["doc_id"], F.col("version")).count() == 0
    one = spark.createDataFrame([(4, "x")], "doc_id long, text string").withColumn("version", F.xxhash64("text"))
    assert spotsigs.with_next(one, "doc_id", ["doc_id"], F.col("version")).first().next_doc_id == 4


def test_op6_query(spark, tmp_path, rows):
    unique = [r for r in rows if r[0] is not None]
    unique = list({r[0]: r for r in unique}.values())
    spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in spotsigs.op6_query(spark, str(tmp_path)).collect()}
    order = sorted(unique)
    for r, nxt in zip(order, [*order[1:], order[0]]):
        t, n, g = r[1] or "", nxt[1] or "", got[r[0]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(jaccard(spots(t), spots(edited))) and g.near_next == pytest.approx(jaccard(spots(t), spots(n)))
    check_links({r[0]: spots(r[1]) for r in unique}, got)


def check_links(sets, got):
    """Class ids and link counts against all pairs."""
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    for i, s in sets.items():
        links = sum(jaccard(s, o) >= 0.8 for o in least if o != s and o and s)
        assert (got[i].class_id, got[i].n_links) == (least[frozenset(s)], links), i
    return sum(g.n_links for g in got.values())


def test_op6_links_of_crowded_signatures(spark, tmp_path, monkeypatch):
    # One passage in every text, near copies of several lengths, repeated ids; small blocks.
    monkeypatch.setattr(spotsigs, "BLOCK", 7)
    monkeypatch.setattr(spotsigs, "CROWDED", 3)
    rng = random.Random(12)
    passage = " ".join(f"the p{i} q{i}" for i in range(30))
    texts = [passage + " " + " ".join(f"a x{rng.randrange(400)} y{i}" for _ in range(rng.randrange(12))) for i in range(60)]
    texts += [f"{rng.choice(texts)} of more{i} words{i}" for i in range(30)] + texts[:5] + [None, "", "!!"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in spotsigs.op6_query(spark, str(tmp_path)).collect()}
    assert check_links({i: spots(t) for i, t in rows}, got) > 1000


def test_op6_links_are_counted_without_rows_of_pairs(spark, monkeypatch):
    # 40 near copies, all linked with each other: a row a member of a meeting, none a pair.
    from siftstone.llm.common import Store

    monkeypatch.setattr(spotsigs, "BLOCK", 16)
    base = [f"the p{i} q{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"the x{i} y{i}"] + base[i + 1 :])) for i in range(40)]
    store = Store(spark)
    classes = spotsigs.numbered(spotsigs.signed(spark.createDataFrame(rows, "id long, text string")).drop("text"), store)
    met = spotsigs.meetings(classes, 0.8, store).collect()
    assert max(len(r.members) for r in met) <= 40
    found = spotsigs.linked(classes, 0.8, store).collect()
    assert sum(len(r.near) for r in found) == 40 * 39 and len({(r.c, x.c) for r in found for x in r.near}) == 40 * 39
    assert len(found) < 40 * 39 / 2


def test_likeness_within_a_meeting(spark, monkeypatch):
    """Likeness is exact for members near the first one and for others; sets meet in any order."""
    from siftstone.llm.common import Store

    for block in (4, 512):
        monkeypatch.setattr(spotsigs, "BLOCK", block)
        rng = random.Random(31)
        base = [f"the p{i} q{i}" for i in range(50)]
        texts = []
        for i in range(36):
            some = list(base) if i % 3 else base[:25] + [f"of u{k} v{k}" for k in range(25)]
            for k in rng.sample(range(50), rng.choice([0, 1, 4, 7])):
                some[k] = f"the x{rng.randrange(3)} y{k}"
            texts.append(" ".join(some))
        store = Store(spark)
        classes = spotsigs.numbered(spotsigs.signed(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).drop("text"), store)
        sets = {r.c: set(r.s) for r in classes.collect()}
        want = {(a, b): jaccard(x, y) for a, x in sets.items() for b, y in sets.items() if a != b and jaccard(x, y) >= 0.8}
        linked = spotsigs.linked(classes, 0.8, store)
        got = [((r.c, x.c), x.likeness) for r in linked.collect() for x in r.near]
        assert len(got) == len(want) and dict(got) == pytest.approx(want) and len(want) > 100
        for plan in (linked, spotsigs.active(classes, 0.8, store)):  # comparisons are made once, not in a filter before as well
            lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
            assert not any("Filter" in x and "lambda" in x for x in lines) and any("lambda" in x for x in lines)


def test_words_without_a_pass_for_each(spark):
    """Punctuation around words goes in one pass over the text."""
    texts = ["--a-- 'b'c' ...", " (x)\t\"y\"\r\n z, ,", "", " ", "...", "\u201cq\u201d \u2026 \u00df\u0301 \U0001f600d\U0001f600", "a" + "-" * 5000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in df.select("i", spotsigs.bare_words(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        bare = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in words(t)]
        assert got[i] == [b.rstrip("\u0301") for b in bare if b], t
    assert "regexp_replace" not in df.select(spotsigs.signatures(F.col("t")))._jdf.queryExecution().toString()


def test_classes_without_ids(spark):
    # Repeated ids of different texts and rows without an id are classes of their own.
    base = "the a1 b1 and c1 d1 of e1 f1 to g1 h1 in i1 j1 is k1 l1 at m1 n1 by o1 p1"
    near, far = base + " was q1 r1", "the z1 z2 and z3 z4"
    rows = [(None, base), (None, near), (7, base), (7, far), (None, far + " of z5 z6"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.xxhash64("text"))
    facts = {(r.fact_key, r.fact_version): (r.class_id, r.n_links) for r in spotsigs.class_facts(docs).collect()}
    versions = [r.version for r in docs.collect()]
    last = 2**63 - 1
    assert [facts[(i if i else last, v)] for (i, _), v in zip(rows, versions)] == [(7, 1), (None, 1), (7, 1), (7, 0), (None, 0), (None, 0)]
    pairs, members = spotsigs.similar_pairs(docs)
    assert [(r.a, r.b) for r in pairs.collect()] in ([(7, None)], [(None, 7)]) and members.count() == 6


def test_ids_that_fill_ranges(spark):
    # A third of the rows without an id, a third with the same one.
    rows = [(None, f"n{i}") for i in range(200)] + [(77, f"h{i}") for i in range(200)] + [(i, f"t{i}") for i in range(200)]
    out = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.xxhash64("text")), "doc_id", ["doc_id", "text"], F.col("version")).collect()
    following = {(r.doc_id, r.text): (r.next_doc_id, r.next_text) for r in out}
    assert len(out) == 600 == len(following) == len(set(following.values()))
    at, seen = (0, "t0"), []
    for _ in range(600):
        seen.append(at)
        at = following[at]
    assert at == (0, "t0") and [s[0] for s in seen] == sorted([r[0] for r in rows if r[0] is not None]) + [None] * 200


def test_spotsigs_edges(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert spotsigs.op6_query(spark, str(tmp_path)).count() == 0
    pairs, members = spotsigs.similar_pairs(none)
    assert pairs.count() == members.count() == 0
    clash = spark.createDataFrame([(1, "the cat sat down", 5, 6, 7)], "doc_id long, text string, SIGNATURES int, fingerprint int, sigs_of_row int")
    got = spotsigs.fingerprints(clash)
    assert got.columns == ["doc_id", "text", "sigs_of_row", "signatures", "fingerprint"] and len(got.first().signatures) == len(spots("the cat sat down"))


# --- toxicity


def made_labels(n=400, seed=4):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(["awful", "vileza", "vilest"])
        if rng.random() < (0.6 if toxic else 0.1):
            w.insert(3, "muslim")
        elif rng.random() < 0.3:
            w.insert(5, "christian")
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_fit_does_not_diverge_where_a_few_words_decide():
    """Rare labels, told by one of a few words: whole Newton steps overshot and all scores were zero."""
    import numpy as np

    rng = np.random.default_rng(5)
    y = (rng.random(1000) < 0.05).astype(int)
    rows = [sorted({*([int(rng.integers(5))] if p else []), *(5 + rng.integers(60, size=12)).tolist()}) for p in y]
    names = [f"f{k}" for k in range(65)]
    model = toxicity.solve(names, rows, [None] * len(rows), y, np.ones(len(rows)))
    scores = np.array([model.intercept + sum(model.weights.get(names[k], 0.0) for k in r) for r in rows])
    assert scores[y == 1].min() > scores[y == 0].max() and -50 < model.intercept < 0


def test_swapping_identity_terms_moves_no_score():
    rows = made_labels()
    texts, y = [r[1] for r in rows], [r[2] for r in rows]
    free, fair = (toxicity.fit(texts, y, fairness=x) for x in (0.0, 30.0))
    logit = lambda m, t: math.log(m.score(t) / (1 - m.score(t)))
    gap = lambda m: abs(logit(m, "word1 muslim word2") - logit(m, "word1 christian word2"))
    assert gap(fair) < 0.1 < 0.8 < gap(free)
    assert fair.score("word1 awful") > 0.5 > fair.score("word1 word2 muslim")
    assert toxicity.swaps({"muslim", "x"}, 0) is not None and toxicity.swaps({"x"}, 0) is None


def test_scoring_equals_the_model_and_generalises(spark, none):
    rows = made_labels(600)
    docs = spark.createDataFrame([(r[0], r[1], 7) for r in rows] + [(9000, None, 7), (9001, "", 7)], "doc_id long, text string, text_of_row int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_rows=300)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in rows:
        assert got[r[0]].score == pytest.approx(model.score(r[1])) and got[r[0]].text_of_row == 7
    assert got[9000].score == got[9001].score == pytest.approx(model.score(""))
    held = [(got[r[0]].score, r[2]) for r in rows if r[0] % 3 == 0]
    assert np.mean([(s >= 0.3) == bool(t) for s, t in held]) > 0.9
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 1")).score("x") > 0.99
    assert toxicity.train(docs, labels.limit(0)).score("x") < 0.01


def test_train_on_a_table_equals_fit(spark):
    rows = made_labels(500)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    table, plain = toxicity.train(docs, labels), toxicity.fit([r[1] for r in rows], [r[2] for r in rows])
    for t in ("word1 awful", "word1 word2 muslim", "", "vilest christian word9"):
        assert table.score(t) == pytest.approx(plain.score(t), abs=1e-6)


def test_op3_query_learns_nothing_from_the_held_out_fold(spark, tmp_path):
    import zlib

    rows = made_labels(800) + [(5000, None, 0), (5001, "", 0)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = []
    for name, flip in (("a", 0), ("b", 1)):
        sf = tmp_path / name
        spark.createDataFrame([(r[0], r[1], "en", "s") for r in rows], "doc_id long, text string, lang string, source string").write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame([(r[0], 1 - r[2] if flip and fold(r[0]) else r[2], 1) for r in rows], "doc_id long, toxic int, quality int").write.parquet(str(sf / "labels.parquet"))
        got = {r.doc_id: r for r in toxicity.op3_query(spark, str(sf)).collect()}
        assert len(got) == len(rows) and all(got[r[0]].held_out == fold(r[0]) and got[r[0]].predicted == int(got[r[0]].score >= 0.3) for r in rows)
        scores.append({i: r.score for i, r in got.items()})
    assert scores[0] == pytest.approx(scores[1])
    held = [(scores[0][r[0]] >= 0.3) == bool(r[2]) for r in rows[:800] if fold(r[0])]
    assert sum(held) > 0.9 * len(held) > 100
