"""Near copies by SimHash anchors, reaching Jaccard 0.8 of five-word shingles.

Equal sets of shingles are folded first.  Candidates then come from two places.
Operator 7's covering code links SimHashes (here of five words) within 2 bits;
that finds most of what is nearly equal, but texts at Jaccard 0.8 differ in about
ten of 64 bits, which no covering reaches at a bearable number of replicas.  So
MinHash bands find the rest: ``BANDS`` bands of ``ROWS`` minima, so that a pair at
the threshold shares no band with a chance of (1 - 0.8**5)**32, about 3 in a
million.  Every link is confirmed on the whole sets of shingles.

Not every pair of a bucket need be compared, as only components count.  First,
with the anchors' pairs, the members of each bucket meet one leader (another one in
each of ``LEADERS`` rounds), which costs as many pairs as the bucket has members and joins a large
group of near copies.  Then all pairs of a bucket that are not yet in one
component and were not compared are, so that no link is lost.

Before sets are compared, two bounds that lose nothing: sizes must be within the
threshold of each other, and the parity bitmaps of two sets (``BITS`` bits, a
shingle flips the one that its hash names) differ in at most as many bits as the
sets differ in shingles, which the threshold limits.

Words are maximal runs outside [\\x20\\x09-\\x0D], ASCII letters lower-cased; a
text of fewer than five words is one shingle.

Rows: null or wordless texts have the empty set and are linked to each other; a
null id counts as the largest; among rows that share the least id the least
text hash is kept, and of rows that share both the least by their other columns.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch
from .common import LAST_KEY, Store, col, free, least_rows
from .components import merged
from .simhash import near_pairs, simhashes
from .textbatch import U64, Words, chunks, mix, runs_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
LEADERS = 2
BITS = 1024


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts, sorted within each, and the
    n + 1 places where each text's begin."""
    words = Words(texts)
    low = words.buf.copy()
    low[(low >= 65) & (low <= 90)] += 32
    words.buf = low
    hashes, n, doc_of = words.hashes(), words.counts(), words.doc_of()
    docs, grams = [], []
    for k in range(1, shingle + 1):
        runs = runs_of(hashes, k)
        at = np.arange(len(runs))
        if k < shingle:
            at = words.first[:-1][n == k]
        else:
            at = at[doc_of[at] == doc_of[at + k - 1]] if len(at) else at
        docs.append(doc_of[at])
        grams.append(mix(runs[at] + U64(k)))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[new], gram[new]
    return gram, np.searchsorted(doc, np.arange(len(n) + 1))


def set_hashes(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each set; 0 for the empty one."""
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(gram), dtype=U64)))
    n = np.diff(first)
    return np.where(n > 0, mix((total[first[1:]] - total[first[:-1]]) ^ mix(n.astype(U64))), U64(0))


def band_keys(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set that is not empty a row of ``BANDS`` hashes of ``ROWS`` minima."""
    lead = first[:-1][np.diff(first) > 0]
    seeds = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(-1, 2)
    out = np.zeros((len(lead), BANDS), U64)
    if not len(lead):
        return out
    scratch = np.empty_like(gram)
    for i, (a, b) in enumerate(seeds):
        np.bitwise_xor(gram, a, out=scratch)
        np.multiply(scratch, b | U64(1), out=scratch)
        out[:, i // ROWS] = mix(out[:, i // ROWS] ^ np.minimum.reduceat(scratch, lead)) + U64(i // ROWS)
    return out


def parities(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set, as ``BITS`` / 64 longs."""
    n = len(first) - 1
    bit = (mix(gram) >> U64(20)).astype(np.int64) & (BITS - 1)
    cell = np.repeat(np.arange(n), np.diff(first)) * BITS + bit
    odd = (np.bincount(cell, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, BITS // 64)


_PRINT = "id long, version long, fp long, n int, sim long, odd array<long>, bands array<long>"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = part.column(2)
            gram, first = shingle_sets(texts)
            bands = band_keys(gram, first).view(np.int64)
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.reshape(-1)))
            held = lists(np.concatenate(([0], np.cumsum((np.diff(first) > 0) * BANDS))), bands)
            odd = lists(np.arange(part.num_rows + 1) * (BITS // 64), parities(gram, first))
            sims = simhashes(texts, SHINGLE).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_hashes(gram, first).view(np.int64)), pa.array(np.diff(first).astype(np.int32)), pa.array(sims), odd, held], ["id", "version", "fp", "n", "sim", "odd", "bands"])
    textbatch.end_task()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            gram, first = shingle_sets(part.column(2))
            held = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(gram, first).view(np.int64)), held], ["fp", "grams"])
    textbatch.end_task()


def _may(na: Column, oa: Column, nb: Column, ob: Column, threshold: float) -> Column:
    """Whether sizes and parity bitmaps leave the threshold possible."""
    differ = sum((F.bit_count(F.get(oa, F.lit(i)).bitwiseXOR(F.get(ob, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - 1e-9
    return sizes & (differ <= F.lit((1 - threshold) / (1 + threshold)) * (na + nb) + 1e-9)


def _bounded(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that the bounds leave."""
    a, b = (classes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where(_may(F.col("na"), F.col("oa"), F.col("nb"), F.col("ob"), threshold)).select("a", "b")


def _confirm(pairs: DataFrame, classes: DataFrame, slim: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of set hashes whose sets have the threshold."""
    asked = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    rows = classes.join(asked, "fp", "left_semi").select("id", "version")
    sets = slim.join(rows, ["id", "version"], "left_semi").mapInArrow(_sets, "fp long, grams array<long>").groupBy("fp").agg(F.first("grams").alias("grams"))
    a, b = sets.select(F.col("fp").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("double")
    alike = both >= F.lit(threshold) * (F.size("ga") + F.size("gb") - both) - 1e-9
    return pairs.join(a, "a").join(b, "b").where(alike).select("a", "b")


def _sim_pairs(classes: DataFrame, store: Store) -> DataFrame:
    """Pairs (a, b) of set hashes whose SimHashes are equal, by the least of
    each SimHash, or that operator 7 links."""
    named = store.keep(classes.groupBy("sim").agg(F.min("fp").alias("lead")))
    same = classes.select("fp", "sim").join(named, "sim").where("fp <> lead").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    near = near_pairs(named.select(F.col("sim").alias("fp")))
    a, b = (named.select(F.col("sim").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "ab")
    near = near.join(a, "a").join(b, "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    return same.unionByName(near)


def _led(open_rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with its leader of this round."""
    first = open_rows.groupBy("bucket").agg(F.min_by(F.struct("fp", "root"), F.xxhash64("fp", F.lit(turn))).alias("lead"))
    return open_rows.join(first, "bucket").where("root <> lead.root").select(F.least("fp", "lead.fp").alias("a"), F.greatest("fp", "lead.fp").alias("b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, version, root), one for each document (a null id is
    ``LAST_KEY``): a hash of the text and the name of its component."""
    store = Store(docs.sparkSession)
    slim = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(LAST_KEY)).alias("id"), F.xxhash64(col(text_col)).alias("version"), col(text_col).alias("text"))
    prints = store.keep(slim.mapInArrow(_prints, _PRINT))
    # Equal sets have equal bands.
    held = F.min_by(F.struct("id", "version", "n", "sim", "odd", "bands"), F.struct("id", "version")).alias("x")
    classes = store.keep(prints.groupBy("fp").agg(held).select("fp", "x.*"))
    # One exchange serves the count and the join.
    banded = classes.select("fp", F.explode("bands").alias("bucket")).repartition("bucket")
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    # The planner takes the exploded rows for as few as the classes.
    open_rows = store.keep(banded.hint("merge").join(crowded, "bucket").select("bucket", "fp"))
    near = _sim_pairs(classes, store)
    if LEADERS:
        near = near.unionByName(_led(open_rows.withColumn("root", F.col("fp")), 0))
    tried = pairs = store.keep(_bounded(near.distinct(), classes, threshold))
    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = merged(none, store.keep(_confirm(pairs, classes, slim, threshold)), store)
    for turn in range(min(1, LEADERS), LEADERS + 1):
        named = open_rows.select("bucket", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root"))
        split = named.groupBy("bucket").agg(F.min("root").alias("l"), F.max("root").alias("g")).where("l < g").select("bucket")
        open_rows = store.keep(named.join(split, "bucket"))
        if open_rows.isEmpty():
            break
        if turn < LEADERS:
            pairs = _bounded(_led(open_rows, turn).distinct().join(tried, ["a", "b"], "left_anti"), classes, threshold)
        else:
            full = store.keep(open_rows.join(classes.select("fp", "n", "odd", "bands"), "fp"))
            x, y = (full.select("bucket", F.col("fp").alias(k), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}"), F.col("bands").alias(f"s{k}")) for k in "ab")
            may = _may(F.col("na"), F.col("oa"), F.col("nb"), F.col("ob"), threshold)
            # All buckets that such a pair shares are open still; it comes from the first.
            here = x.bucket == F.get(F.array_intersect("sa", "sb"), F.lit(0))
            met = x.join(y, (x.bucket == y.bucket) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & may & here).select("a", "b")
            pairs = met.distinct().join(tried, ["a", "b"], "left_anti")
        pairs = store.keep(pairs)
        found = store.keep(_confirm(pairs, classes, slim, threshold))
        tried, roots = tried.unionByName(pairs), merged(roots, found, store)
    out = prints.select("id", "version", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return out.select("id", "version", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, by the least id, then the least text hash."""
    key, version = free(docs, "row_key", "row_version")
    first = groups(docs, id_col, text_col, threshold).groupBy("root").agg(F.min(F.struct("id", "version")).alias("x"))
    first = first.select(F.col("x.id").alias(key), F.col("x.version").alias(version))
    keyed = docs.withColumns({key: F.coalesce(col(id_col).cast("long"), F.lit(LAST_KEY)), version: F.xxhash64(col(text_col))})
    return least_rows(keyed.join(first, [key, version], "left_semi"), docs.columns, [key, version])
