"""Dense and sparse search, rank fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions.lineage import kept
from siftstone.functions.text import tokens
from siftstone.functions.vectors import cosine

#: Queries that a task holds, rows that it meets at once, and rows of a cell of
#: the grid of many queries and a corpus.
BLOCK, CHUNK, CELL = 4096, 1024, 200_000
#: Rows that a bucket of the approximate index holds on average, and those of a
#: crowded one that a task meets.
BUCKET, PART = 512, 4096
K1, B, RRF = 1.5, 0.75, 60


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; rows of another length or null are zero."""
    out = np.zeros((len(col), width))
    sizes = np.asarray(col.value_lengths().fill_null(0))
    flat = np.asarray(col.flatten(), np.float64)
    ok = sizes == width
    if ok.any():
        starts = np.cumsum(sizes) - sizes
        out[ok] = flat[starts[ok][:, None] + np.arange(width)]
    return out


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "id", *keys: str) -> DataFrame:
    """The k best by score, ties by id; Spark prunes before the shuffle."""
    order = (F.col(score).desc_nulls_last(), F.col(id_col))
    if not keys:
        return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best ids of each query so far, by score, ties by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all queries for these ids.  Only what reaches a query's
        last place is sorted."""
        last = self.score[:, -1:]
        row, col_ = np.nonzero((score > last) | ((score == last) & (ids < self.id[:, -1:]) & ~np.isneginf(score)))
        if not len(row):
            return
        hit = np.unique(row)
        rows = np.concatenate((np.repeat(hit, self.k), row))
        s = np.concatenate((self.score[hit].ravel(), score[row, col_]))
        i = np.concatenate((self.id[hit].ravel(), ids[col_]))
        order = np.lexsort((i, -s, rows))
        rows, s, i = rows[order], s[order], i[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.score[rows[keep], place[keep]], self.id[rows[keep], place[keep]] = s[keep], i[keep]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        found = ~np.isneginf(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(1))), pa.array(self.id[found]), pa.array(self.score[found])], ["qid", "id", "score"])


def _meet(ids: np.ndarray, q: np.ndarray, k: int, keep_self: bool, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The k best of some corpus rows for each unit query."""
    best, size = _Best(len(ids), k), 64
    for own, vectors in parts:
        at = 0
        while at < len(own):  # few rows first, so that soon little is left to sort
            some = own[at : at + size]
            score = np.round(q @ _unit(vectors[at : at + size]).T, 6) + 0.0
            if not keep_self:
                score[ids[:, None] == some[None, :]] = -np.inf
            best.add(score, some)
            at, size = at + size, min(2 * size, CHUNK)
    return best.batch(ids)


def knn(queries: DataFrame, corpus: DataFrame, k: int, keep_self: bool = True) -> DataFrame:
    """Exact cosine neighbours: (qid, id, score, rank); scores at 6 places.

    ``queries`` has qid and embedding, ``corpus`` id and embedding; vectors of
    another length than the longest query are like none (score 0).  Up to
    ``BLOCK`` queries go to every task with the plan and meet its rows as matrix
    products.  More are dealt into blocks, and the corpus into parts: a block
    meets a part in a task of its own, so that no task holds more than ``BLOCK``
    queries and ``CELL`` rows, and nothing passes through the driver.  Every cell
    keeps its own k best of each query, and only those are shuffled.
    """
    schema = "qid long, id long, score double"
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") > 0)
    rows = corpus.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    few = asked.limit(BLOCK + 1).collect()
    if not few:
        return corpus.sparkSession.createDataFrame([], f"{schema}, rank int")
    if len(few) <= BLOCK:
        width = max(len(r[1]) for r in few)
        ids, q = np.array([r[0] for r in few], np.int64), np.zeros((len(few), width))
        for i, r in enumerate(few):
            if len(r[1]) == width:
                q[i] = r[1]
        q = _unit(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _meet(ids, q, k, keep_self, ((np.asarray(b.column(0), np.int64), _vectors(b.column(1), width)) for b in batches))

        return top_k(rows.mapInArrow(run, schema), k, "score", "id", "qid")

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.asarray(left["qid"], np.int64)
        some = ((np.asarray(b.column(2), np.int64), _vectors(b.column(3), width)) for b in right.to_batches(max_chunksize=CHUNK))
        return pa.Table.from_batches([_meet(own, _unit(_vectors(left["embedding"].combine_chunks(), width)), k, keep_self, some)])

    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks, parts = n // BLOCK + 1, rows.count() // CELL + 1
    deal = lambda df, name, n, other, m: df.select(F.pmod(F.xxhash64(name), F.lit(n)).alias(other[0]), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other[1]), name, "embedding")
    left = deal(asked, "qid", blocks, ("block", "part"), parts).select(F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"), "qid", "embedding")
    right = deal(rows, "id", parts, ("part", "block"), blocks).select(F.col("block").cast("int").alias("block"), F.col("part").cast("int").alias("part"), "id", "embedding")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, schema)
    return top_k(found, k, "score", "id", "qid")


def lsh_bits(rows: int) -> int:
    """Bits of a bucket's code: buckets of about ``BUCKET`` rows at any size."""
    return max(8, min(40, math.ceil(math.log2(max(rows, 1) / BUCKET))))


def lsh_knn(queries: DataFrame, corpus: DataFrame, k: int, tables: int = 24, bits: int | None = None, seed: int = 7, flips: int = 5, keep_self: bool = True) -> DataFrame:
    """Approximate neighbours: rows are indexed by random-hyperplane buckets,
    whose number grows with the corpus.  In each table a query looks into its own
    bucket and those that differ in any of the ``flips`` bits whose planes it is nearest
    to, 2 ** flips buckets at every size; exact cosine ranks what they find, as matrix products
    within a bucket, each of which gives its k best.  Every
    row that has a direction is indexed (the width is the longest query's); a
    crowded bucket's rows are dealt into parts of about ``PART`` for the join.
    Rows are found by likeness alone: corpora without near neighbours are
    served better by ``knn``, which is exact."""
    bits = bits or lsh_bits(corpus.count())
    flips = min(flips, bits)
    width = queries.agg(F.max(F.size("embedding")).alias("w")).first().w or 1
    planes = np.random.default_rng(seed).standard_normal((tables * bits, width))

    def coder(flips: int):
        subsets = (np.arange(2**flips)[:, None] >> np.arange(flips)) & 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _vectors(batch.column(1), width)
                batch, x = batch.filter(pa.array(x.any(1))), x[x.any(1)]
                side = (x @ planes.T).reshape(-1, tables, bits)
                code = ((side > 0) << np.arange(bits)).sum(2)
                near = 1 << np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :flips].astype(np.int64)
                code = (code[:, :, None] ^ (near @ subsets.T)) + (np.arange(tables) << bits)[None, :, None]
                code = code.reshape(len(code), -1).astype(np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * (tables * 2**flips)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], ["id", "embedding", "codes"])

        return run

    plain = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    schema = "id long, embedding array<float>, codes array<long>"
    rows = plain(corpus, "id").mapInArrow(coder(0), schema)
    asked = plain(queries, "qid").mapInArrow(coder(flips), schema)
    # Equal rows are one: a copy would take a place among a bucket's best.
    indexed = kept(rows.dropDuplicates(["id", "embedding"]))
    coded = indexed.select("id", "embedding", F.explode("codes").alias("code"))
    crowded = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = coded.join(crowded, "code").select("code", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")
    probes = asked.select(F.col("id").alias("qid"), "embedding", F.explode("codes").alias("code")).join(crowded, "code")
    probes = probes.select("code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "embedding")

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own, q = np.asarray(left["qid"], np.int64), _unit(_vectors(left["embedding"].combine_chunks(), width))
        met = [pa.RecordBatch.from_pylist([], pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))]
        for a in range(0, len(own) if len(right) else 0, CHUNK):
            some = ((np.asarray(b["id"], np.int64), _vectors(b["embedding"], width)) for b in right.to_batches(max_chunksize=CHUNK))
            met.append(_meet(own[a : a + CHUNK], q[a : a + CHUNK], k, keep_self, some))
        return pa.Table.from_batches(met)

    # A bucket sends on the k best of each query, not every pair.
    found = probes.groupBy("code", "part").cogroup(dealt.groupBy("code", "part")).applyInArrow(cell, "qid long, id long, score double")
    return top_k(found.distinct(), k, "score", "id", "qid")


def term_counts(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, term, tf, dl) for the asked terms only, and corpus totals.  Tokens
    of other terms never leave the row they are in."""
    have = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    sized = have.select("id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(*terms)).alias("hits"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    counts = sized.where(F.size("hits") > 0).select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return counts, totals


def bm25(docs: DataFrame, terms: Sequence[str], k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score, matched_terms, rank) by Robertson's BM25, idf = ln(1 + (N - df + .5) / (df + .5))."""
    counts, totals = term_counts(docs, terms, id_col, text_col)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    both = counts.join(F.broadcast(df), "term").join(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = both.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return top_k(scored, k)


def tfidf(docs: DataFrame, terms: Sequence[str], k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, matched_terms, rank): tf / length times ln((1 + N) / (1 + df)) + 1."""
    counts, totals = term_counts(docs, terms, id_col, text_col)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    both = counts.join(F.broadcast(df), "term").join(F.broadcast(totals))
    part = F.col("tf") / F.col("dl") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    scored = both.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return top_k(scored, k)


def ranked(hits: DataFrame, source: str, *keys: str) -> DataFrame:
    """One row an id and source, by its best rank, with rank from 1."""
    best = hits.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return best.withColumns({"source": F.lit(source), "rank": F.row_number().over(w.orderBy(F.col("score").desc(), "id"))})


def rrf(hits: DataFrame, k: int, constant: int = RRF, *keys: str) -> DataFrame:
    """Reciprocal rank fusion of rows (id, source, rank)."""
    fused = hits.groupBy(*keys, "id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return top_k(fused, k, "score", "id", *keys)


def normalised(hits: DataFrame, *keys: str) -> DataFrame:
    """Scores to [0, 1] in each list; a list without spread is all 1."""
    w = Window.partitionBy(*keys, "source")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("normal", F.when(high - low < 1e-10, 1.0).otherwise((F.col("score") - low) / (high - low)))


def weighted(hits: DataFrame, weights: dict[str, float], k: int, *keys: str) -> DataFrame:
    """Sum of weighted normalised scores; a missing source counts 0."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0))
    fused = normalised(hits, *keys).groupBy(*keys, "id").agg(F.round(F.sum(F.col("normal") * weight), 6).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return top_k(fused, k, "score", "id", *keys)


SOURCES = ("vector", "sparse", "graph")


def fusion_features(hits: DataFrame, *keys: str) -> DataFrame:
    """15 features: three scores, three reciprocal ranks, three presence flags,
    count, three pairwise differences, maximum and mean of present scores."""
    wide = hits.groupBy(*keys, "id").agg(*(x for s in SOURCES for x in (F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"s_{s}"), F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"r_{s}"))))
    score, rank = [F.col(f"s_{s}") for s in SOURCES], [F.col(f"r_{s}") for s in SOURCES]
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    count = sum((c.isNotNull().cast("int") for c in score[1:]), score[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in score[1:]), F.coalesce(score[0], F.lit(0.0)))
    made = {f"f{i}": zero(c) for i, c in enumerate(score)}
    made |= {f"f{i + 3}": zero(1 / rank[i]) for i in range(3)}
    made |= {f"f{i + 6}": c.isNotNull().cast("double") for i, c in enumerate(score)}
    made["f9"] = count.cast("double")
    made |= {f"f{10 + i}": zero(score[a] - score[b]) for i, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))}
    made |= {"f13": zero(F.greatest(*score)), "f14": F.round(total / count, 6)}
    return wide.select(*keys, "id", *(c.alias(n) for n, c in made.items()))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which ids one list has, the other, or both."""
    both = a.select("id").distinct().withColumn("a", F.lit(1)).join(b.select("id").distinct().withColumn("b", F.lit(1)), "id", "full_outer")
    return both.select("id", F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"))


def coverage(scores: Column) -> Column:
    """Mean score, 0 when there is none."""
    return F.coalesce(F.avg(scores), F.lit(0.0))
