"""Token-ID output with constant-time access by document key.

Documents are range-partitioned and sorted by key, and every partition becomes
one shard file, so the shards in order hold all documents in ascending order:

    magic | ids of all documents, unsigned little-endian, end id included, of 16
          | bits where the vocabulary fits, else 32
          | keys (int64), starts (uint64, count + 1 of them), has-key flags
          | index: level sizes, bits of all levels, fingerprints, record numbers
          | footer: counts, bytes an id, places of the parts, magic

The index is a minimal perfect hash of the shard's distinct keys.  At each
level a key sets the bit its hash names; bits named once stay, the others go on
to the next level; a key's slot is the rank of its bit.  Slot tables hold a
32-bit fingerprint of the key, which rejects nearly all foreign keys (the
record's own key settles the rest), and the record's number.  A lookup reads a
few words, however large the shard.  A manifest table lists the shards with
their first and last keys and counts.

A task writes under a name of its own attempt and reports it; only reported
files count, so a task that is run again leaves no half-written shard behind.

Rows: keys are whole numbers (a table whose keys cannot be cast to long is an
error); a null text is empty (only the end id); a null key sorts last and has no
index entry; of rows with the same key the index names the first, the others
follow it (ties are ordered by text hash).  An empty table writes no shard.  Texts are
encoded whole, however long; one text's ids stand in one shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, col, shuffle_width, table
from .textbatch import U64, chunks, mix, ranges
from .tokens import Words, public_path, rows_of

MAGIC = b"SIFTIDS1"
END_ID = 2
FOOTER = struct.Struct("<10Q8s")
#: Words whose ids a worker keeps.
CACHED = 600_000


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by levels of bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits.astype(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bits)))).astype(np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.sizes)))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys.view(U64) + U64(level + 1) * U64(0x9E3779B97F4A7C15)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left, level = [], [], keys.astype(np.int64), 0
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls.place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left, level = left[~alone[at]], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.place(keys[open_], level, size) + self.offset[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & U64(1) == 1
            low = self.bits[word] & ((U64(1) << bit) - U64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(low))[hit]
            open_ = open_[~hit]
        return out


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)


class Encoder:
    """Texts to ids by the tokenizer, which is asked once for each word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        if self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids + self.tokenizer.encode("b", add_special_tokens=False).ids:
            raise ValueError("this tokenizer does not cut texts at white space")
        plain = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.cut = max(plain, key=lambda x: x[1], default=None)
        self.words = Words(CACHED)
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has.  Words are handed over many
        at a time with a special token between, which the tokenizer cuts at."""
        if self.cut is None:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(g) for g in got], np.int64)
        mark, number = self.cut
        groups = [words[i : i + group] for i in range(0, len(words), group)]
        found = self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)
        ids, sizes = [], []
        for g, e in zip(groups, found):
            own = np.array(e.ids, np.uint32)
            at = np.flatnonzero(own == number)
            if len(at) == len(g) - 1:
                bounds = np.concatenate(([-1], at, [len(own)]))
                sizes.append(np.diff(bounds) - 1)
                ids.append(np.delete(own, at))
            else:  # a word holds the special token itself
                alone = [x.ids for x in self.tokenizer.encode_batch_fast(g, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in alone], np.int64))
                ids.append(np.fromiter(chain.from_iterable(alone), np.uint32))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and how many each has."""
        index, sizes, new, keep = self.words.read(texts)
        if keep is not None:
            self.first, self.ids = rows_of(self.first, self.ids, keep)
        if new:
            ids, sizes_of = self.encode_words([w.decode("utf-8", "replace") for w in new])
            self.ids = np.concatenate((self.ids, ids))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes_of)))
        counts = (self.first[1:] - self.first[:-1])[index]
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        per_text = total[ends[1:]] - total[ends[:-1]] + 1
        out = np.full(int(per_text.sum()), end, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(per_text) - 1] = False
        out[body] = self.ids[ranges(self.first[:-1][index], counts)]
        return out, per_text


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This worker's encoder; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def footer(*values: int) -> bytes:
    return FOOTER.pack(*values, MAGIC)


def open_fs(path: str):
    """A file system and the path in it, for any scheme that Arrow knows; Hadoop's
    names of the same stores are taken for Arrow's."""
    from pyarrow import fs

    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://"), ("wasbs://", "abfs://")):
        path = arrow + path[len(hadoop) :] if path.startswith(hadoop) else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, out, keys, flags, counts = encoder_of(tokenizer), None, [], [], []
        width = encoder.width if end < 1 << 16 else 4
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for part in chunks(batch, "text"):
                if out is None:
                    system, where = open_fs(f"{folder}/{name}")
                    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(where)
                    out.write(MAGIC)
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                ids, n = encoder.encode(get("text"), end)
                out.write(ids.astype(f"<u{width}").tobytes())
                counts.append(n)
                flags.append(np.asarray(get("key").is_valid()))
                keys.append(np.asarray(get("key").fill_null(0), np.int64))
        if out is None:
            return
        keys, flags, counts = (np.concatenate(x) for x in (keys, flags, counts))
        starts = np.concatenate(([0], np.cumsum(counts)))
        first = np.flatnonzero(flags & np.concatenate(([True], (keys[1:] != keys[:-1]) | ~flags[:-1])))
        index = PerfectHash.build(keys[first])
        slot = index.slots(keys[first])
        prints, record = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
        prints[slot], record[slot] = key_prints(keys[first]), first
        place, at = len(MAGIC) + width * int(starts[-1]), []
        for x in (keys.astype("<i8"), starts.astype("<u8"), flags.astype("u1"), index.sizes.astype("<i8"), index.bits.astype("<u8"), prints.astype("<u4"), record.astype("<u4")):
            at.append(place)
            out.write(x.tobytes())
            place += x.nbytes
        out.write(footer(len(keys), len(first), width, *at))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": [number], "file": [name], "n_docs": [len(keys)], "n_ids": [int(starts[-1])],
                                          "first_key": pa.array([int(keys[0]) if flags[0] else None], pa.int64()), "last_key": pa.array([int(keys[flags][-1]) if flags.any() else None], pa.int64())})

    return run


MANIFEST = "shard long, file string, n_docs long, n_ids long, first_key long, last_key long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END_ID) -> DataFrame:
    """Write all documents' ids to ``folder``, a place that all executors and
    the driver share; gives the manifest, which is also written there, with
    ``first_id``: ids in all shards before."""
    keyed = docs.select(col(id_col).cast("long").alias("key"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("version"))
    order = [F.col("key").asc_nulls_last(), F.col("version")]
    dealt = keyed.repartitionByRange(shuffle_width(docs), *order).sortWithinPartitions(*order).select("key", "text")
    made = dealt.mapInArrow(_write(folder, tokenizer, end), MANIFEST)
    made.write.parquet(f"{folder}/written")
    spark = docs.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/written").withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    listed.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark, folder: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, first_id long").parquet(f"{folder}/manifest")


class Shard:
    """An open shard: lookups by key, ids by record number."""

    def __init__(self, path: str):
        system, where = open_fs(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        self.n, self.distinct, self.width, *at, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        at.append(size - FOOTER.size)
        part = lambda i, kind: np.frombuffer(self.file.read_at(at[i + 1] - at[i], at[i]), kind)
        self.keys, self.starts, self.flags = part(0, "<i8"), part(1, "<u8").astype(np.int64), part(2, "u1").astype(bool)
        self.index = PerfectHash(part(3, "<i8"), part(4, "<u8"))
        self.prints, self.record = part(5, "<u4"), part(6, "<u4")

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The record of each key, -1 for keys that the shard does not hold."""
        keys = np.ascontiguousarray(keys, np.int64)
        slot = self.index.slots(keys)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == key_prints(keys[found])
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.record[slot[found]]
        held = out >= 0
        out[held] = np.where(self.keys[out[held]] == keys[held], out[held], -1)
        return out

    def ids(self, record: int, count: int = 1) -> np.ndarray:
        """The ids of ``count`` records, in one read."""
        a, b = int(self.starts[record]), int(self.starts[record + count])
        return np.frombuffer(self.file.read_at(self.width * (b - a), len(MAGIC) + self.width * a), f"<u{self.width}").astype("<u4")


def _read(folder: str, records: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(f"{folder}/{row['file']}")
                # Every key is looked up; repeated keys follow their first record.
                first = np.where(shard.flags, shard.lookup(shard.keys), np.arange(shard.n))
                if (shard.keys[first] != shard.keys).any() or (first < 0).any():
                    raise ValueError(f"the index of {row['file']} misses a key")
                for a in range(0, shard.n, records):
                    b = min(a + records, shard.n)
                    ids = shard.ids(a, b - a)
                    s = shard.starts[a : b + 1]
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * (x - s[0]) : 4 * (y - s[0])]) for x, y in zip(s[:-1].tolist(), s[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(shard.keys[a:b], mask=~shard.flags[a:b]), "start": pa.array(s[:-1] + row["first_id"]),
                        "n_tokens": pa.array(np.diff(s)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_records(spark, folder: str) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32) of all documents in the files."""
    shards = read_manifest(spark, folder)
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(_read(folder), "key long, start long, n_tokens long, ids_crc32 long")


def op5_query(spark, sf_dir: str) -> DataFrame:
    folder = Store(spark).home
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_path("word_bpe_49k.json"))
    return read_records(spark, folder).withColumnRenamed("key", "doc_id")
