"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code: the product of ``blocks`` binary
Golay codes [23, 12] on the first bits of the 64-bit fingerprint.  That code is
perfect with covering radius 3, so every block of 23 bits has exactly one
anchor within 3.  Two fingerprints within ``distance`` bits differ, over all
blocks together, in at most that many: the anchor nearest to the one lies
within radius + distance of the other.  Every distinct fingerprint therefore
stays *home* at its nearest anchor and is replicated to every anchor within the
covering radius plus the threshold (about 61 of 2**24 for two blocks and
distance 2), and only homes and replicas of the same anchor are compared.  No
link is missed.  A fingerprint has at most 2080 others within distance 2, so
links are linear in distinct fingerprints; equal ones are folded first.

Components are found by ``components`` over distinct fingerprints.

Rows: null or wordless texts have fingerprint zero and are linked like any
other; a null id is never the least of its component unless all ids are null;
repeated rows are each kept.  An empty table gives an empty result.  Texts count whole,
however long; the bits are summed over all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_KEY, Store, col, free, least_rows
from .components import components
from .textbatch import U64, Words, chunks, ranges

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Two Golay blocks: 2**24 anchors; a third block would serve beyond some 10**9 distinct fingerprints.
BLOCKS = 2
RADIUS, LENGTH, CHECKS = 3, 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101


def simhashes(col: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text: majority bits of its shingles' XXH64."""
    import xxhash

    words = Words(col)
    n = words.counts()
    lengths = words.end - words.start + 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[ranges(at[:-1], lengths - 1)] = words.buf[ranges(words.start, lengths - 1)]
    upper = (joined >= 65) & (joined <= 90)
    joined[upper] += 32
    many = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    first = ranges(words.first[:-1], many)
    last = np.where(n[doc] >= shingle, first + shingle - 1, words.first[doc] + n[doc] - 1)
    raw, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(at[first].tolist(), (at[last + 1] - 1).tolist())), U64, len(first))
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(many)
    if len(full):
        lead = (np.cumsum(many) - many)[full]
        for bit in range(64):
            ones = np.add.reduceat(((h >> U64(bit)) & U64(1)).astype(np.int64), lead)
            out[full] |= (2 * ones > many[full]).astype(U64) << U64(bit)
    return out


def golay_patterns(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bit patterns of weight up to ``radius`` by syndrome: the patterns
    sorted by syndrome and weight, their weights, and each syndrome's start."""
    syndrome = []
    for i in range(LENGTH):
        x = 1 << i
        for j in range(LENGTH - 1, CHECKS - 1, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - CHECKS)
        syndrome.append(x)
    found = []
    for weight in range(radius + 1):
        for bits in combinations(range(LENGTH), weight):
            e = s = 0
            for i in bits:
                e |= 1 << i
                s ^= syndrome[i]
            found.append((s, weight, e))
    found = np.array(sorted(found), np.int64)
    return found[:, 2], found[:, 1], np.searchsorted(found[:, 0], np.arange((1 << CHECKS) + 1))


class Anchors:
    """The covering code; built once in each worker."""

    def __init__(self, distance: int, blocks: int):
        if not 1 <= blocks * LENGTH <= 64:
            raise ValueError("blocks of 23 bits must fit 64 bits")
        self.distance, self.blocks = distance, blocks
        self.pattern, weight, start = golay_patterns(RADIUS + distance)
        excess = np.maximum(weight - RADIUS, 0)
        group = np.repeat(np.arange(1 << CHECKS), np.diff(start))
        # Patterns of a syndrome with the given excess: from where, how many.
        self.count = np.zeros((1 << CHECKS, distance + 1), np.int64)
        np.add.at(self.count, (group, excess), 1)
        self.begin = start[:-1, None] + np.cumsum(self.count, 1) - self.count
        tables = np.zeros((LENGTH, 2), np.int64)
        for e, s in zip(self.pattern.tolist(), group.tolist()):
            if e and e & (e - 1) == 0:
                tables[e.bit_length() - 1] = e, s
        self.bits = tables

    def _syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for e, s in self.bits.tolist():
            out ^= np.where(x & e, s, 0)
        return out

    def near(self, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of fingerprint, anchor) for every anchor within the radius
        plus ``distance``; with 0, the one home of each."""
        index = np.arange(len(prints))
        anchor, spent = np.zeros(len(prints), np.int64), np.zeros(len(prints), np.int64)
        for b in range(self.blocks):
            word = ((prints >> U64(b * LENGTH)) & U64((1 << LENGTH) - 1)).astype(np.int64)
            syndrome = self._syndrome(word)
            parts = []
            for excess in range(distance + 1):
                ok = np.flatnonzero(spent + excess <= distance)
                s = syndrome[index[ok]]
                n = self.count[s, excess]
                i = np.repeat(ok, n)
                nearest = word[index[i]] ^ self.pattern[ranges(self.begin[s, excess], n)]
                parts.append((index[i], (anchor[i] << (LENGTH - CHECKS)) | (nearest >> CHECKS), spent[i] + excess))
            index, anchor, spent = (np.concatenate(x) for x in zip(*parts))
        return index, anchor


def _replicate(distance: int, blocks: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Anchors(distance, blocks)
        for batch in batches:
            prints = np.asarray(batch.column(0), np.int64)
            for a in range(0, len(prints), 4096):
                part = prints[a : a + 4096]
                i, anchor = code.near(part.view(U64), reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i])], ["anchor", "fp"])

    return run


def near_pairs(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Each pair (a, b) of distinct fingerprints (column ``fp``, distinct
    longs) that differ in at most ``distance`` bits, once."""
    at = "anchor long, fp long"
    home = prints.select("fp").mapInArrow(_replicate(distance, blocks, 0), at).withColumnRenamed("fp", "a")
    copies = prints.select("fp").mapInArrow(_replicate(distance, blocks, distance), at).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # The planner takes the replicas for as few as the fingerprints and would send them to every task through the driver.
    return home.join(copies.hint("merge"), "anchor").where(near).select("a", "b")


def _fingerprint(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                yield pa.RecordBatch.from_arrays([*(get(x) for x in names), pa.array(simhashes(get(text)).view(np.int64))], [*names, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, version, fp): a hash of the text and the SimHash of the whole
    text, as signed longs."""
    slim = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col)).alias("version"), col(text_col).alias("text"))
    return slim.mapInArrow(_fingerprint("text", ["id", "version"]), "id long, version long, fp long")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Rows (id, version, fp, root, component_id), one for each document: the
    least fingerprint and the least id that links of at most ``distance`` bits
    reach."""
    store = Store(docs.sparkSession)
    all_prints = store.keep(fingerprints(docs, id_col, text_col))
    prints = store.keep(all_prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(near_pairs(prints, distance, blocks), store)
    rooted = store.keep(prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = store.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = store.keep(rooted.select("fp", "root").join(least, "root"))
    return all_prints.join(named, "fp").select("id", "version", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of each component: of its least id (a null id counts as the
    largest), among rows that share the id, of the least text hash, and among
    rows that share both the least by their other columns."""
    key, version = free(docs, "row_key", "row_version")
    groups = clusters(docs, id_col, text_col, distance)
    first = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("id", F.lit(LAST_KEY)).alias("id"), "version")).alias("x"))
    first = first.select(F.col("x.id").alias(key), F.col("x.version").alias(version))
    keyed = docs.withColumns({key: F.coalesce(col(id_col).cast("long"), F.lit(LAST_KEY)), version: F.xxhash64(col(text_col))})
    return least_rows(keyed.join(first, [key, version], "left_semi"), docs.columns, [key, version])


def op7_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
