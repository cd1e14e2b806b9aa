"""Exact and near-duplicate detection by MinHash and banding, contamination."""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siftstone.functions.arrays import windows
from siftstone.functions.lineage import dealt, kept
from siftstone.functions.text import shingle_words
from siftstone.functions.vectors import equal_share

#: Fixed values of the signature: a Mersenne prime and the seed of its multipliers.
PRIME, SEED = 2**31 - 1, 42
HASHES, BANDS, ROWS, SHINGLE, THRESHOLD = 128, 16, 8, 3, 0.8
#: Classes of a bucket that one task pairs with the rest of it.
PART = 1024
#: Texts whose shingles a task holds at once.
TEXTS = 32


def multipliers(n: int = HASHES, seed: int = SEED) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    a = [rng.randint(1, PRIME - 1) for _ in range(n)]
    b = [rng.randint(0, PRIME - 1) for _ in range(n)]
    return list(zip(a, b))


def shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, shingle), distinct within each document, before any shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(windows(shingle_words(F.col(text_col)), n))).alias("shingle"))


def _hashes(grams: list[bytes]) -> np.ndarray:
    """Each shingle's md5 modulo the prime, of which 2**32 is 2."""
    words = np.frombuffer(b"".join([md5(g).digest() for g in grams]), ">u4").reshape(-1, 4).astype(np.uint64)
    return (words @ np.array([8, 4, 2, 1], np.uint64)) % np.uint64(PRIME)


def _least(flat: np.ndarray, first: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For each row of hashes (they start at ``first``) and each (a, b) the least
    (a * x + b) modulo the prime.  The prime is 31 ones: the sum of a number's low and
    high bits is below twice the prime, so one subtraction, kept where it does not wrap, ends it."""
    x, low, less = np.empty(len(flat), np.uint64), np.empty(len(flat), np.uint32), np.empty(len(flat), np.uint32)
    out = np.empty((len(first), len(pairs)), np.int64)
    for i, (a, b) in enumerate(pairs):
        np.multiply(flat, np.uint64(a), out=x)
        x += np.uint64(b)
        np.bitwise_and(x, np.uint64(PRIME), out=low, casting="unsafe")
        x >>= np.uint64(31)
        np.add(low, x, out=low, casting="unsafe")
        np.subtract(low, np.uint32(PRIME), out=less)
        np.minimum(low, less, out=low)
        out[:, i] = np.minimum.reduceat(low, first)
    return out


def _signed(n: int, hashes: int):
    """Signatures of a batch's words (joined by a space): the hashes of all its shingles
    stand in one array, and each function takes its minima of every row in one pass."""
    pairs = multipliers(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                grams, first, rows = [], [], []
                for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    words = text.split(b" ")
                    if len(words) >= n and words != [b""]:
                        first.append(len(grams))
                        rows.append(row)
                        grams += map(b" ".join, zip(*(words[i:] for i in range(n))))
                least = _least(_hashes(grams), np.array(first), pairs) if rows else np.zeros((0, hashes), np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * hashes), pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), held], ["id", "signature"])

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """(id, signature), a row a document with n words or more; no shuffle, so
    it works on streams too.  A shingle's hash is its md5 modulo the prime."""
    rows = dealt(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("w")), "id").select("id", F.array_join(shingle_words(F.col("w")), " ").alias("w"))
    return rows.mapInArrow(_signed(n, hashes), StructType([rows.schema["id"], StructField("signature", ArrayType(LongType()))]))


def classes(signed: DataFrame) -> DataFrame:
    """(class_id, signature, n): equal signatures folded to their least id."""
    return signed.groupBy("signature").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))


def buckets(signature: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One hash for each band of a signature."""
    return F.array(*(F.xxhash64(F.lit(i), F.slice(signature, i * rows + 1, rows)) for i in range(bands)))


def candidates(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Pairs (a, b) of classes that share a band.  Buckets of one class go
    before the join; one side of a crowded bucket is dealt into parts of about
    ``PART`` classes, so that no key's pairs are the work of one task."""
    banded = sets.select("class_id", F.explode(buckets(F.col("signature"), bands, rows)).alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = banded.join(crowded, "bucket")
    left = held.select("bucket", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"), F.col("class_id").alias("a"))
    right = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("class_id").alias("b"))
    return left.join(right, ["bucket", "part"]).where("a < b").select("a", "b").distinct()


def near_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) between class representatives."""
    a = sets.select(F.col("class_id").alias("a"), F.col("signature").alias("sa"))
    b = sets.select(F.col("class_id").alias("b"), F.col("signature").alias("sb"))
    scored = candidates(sets).join(a, "a").join(b, "b").withColumn("similarity", F.round(equal_share(F.col("sa"), F.col("sb")), 6))
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def first_match(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every document its earlier original: (id, duplicate_of, similarity).
    An equal text (by md5) comes first, then the most similar earlier class,
    ties by the smaller id.  Ids stand for arrival order."""
    hashed = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("h"))
    firsts = hashed.groupBy("h").agg(F.min("id").alias("first"))
    exact = hashed.join(firsts, "h").select("id", F.when(F.col("first") < F.col("id"), F.col("first")).alias("same"))
    signed = kept(signatures(docs, id_col, text_col))
    sets = kept(classes(signed))
    best = near_pairs(sets, threshold).groupBy(F.col("b").alias("class_id")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("a"))).alias("x"))
    member = signed.join(sets.select("signature", "class_id"), "signature").select("id", "class_id")
    near = member.join(best, "class_id", "left").select("id", F.when(F.col("class_id") < F.col("id"), F.col("class_id")).otherwise(F.col("x.a")).alias("near"), F.when(F.col("class_id") < F.col("id"), 1.0).otherwise(-F.col("x.s")).alias("s"))
    out = exact.join(near, "id", "left")
    return out.select("id", F.coalesce("same", "near").alias("duplicate_of"), F.when(F.col("same").isNotNull(), 1.0).otherwise(F.col("s")).alias("similarity")).where("duplicate_of is not null")


def contamination(docs: DataFrame, items: DataFrame, n: int = 8, share: float = 0.5) -> DataFrame:
    """(item_id, id, share): items of which a document holds at least ``share``
    of the n-word shingles."""
    asked = shingles(items, "item_id", "text", n).withColumnRenamed("id", "item_id")
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    hits = shingles(docs, "doc_id", "text", n).join(asked, "shingle").groupBy("item_id", "id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "item_id").select("item_id", "id", F.round(F.col("hits") / F.col("size"), 6).alias("share")).where(F.col("share") >= share)
