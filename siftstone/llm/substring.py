"""Substring dedup by relative Lempel-Ziv parsing.

A document is parsed greedily into factors, each a copy from a *reference
block*: a document with a smaller id.  Factors of ``window`` words or more are
duplicate spans.  The plan, linear in the corpus:

1. *Index.*  From every run of ``window`` words the anchor of ``k`` words with
   the least hash is taken (a minimizer: equal runs give equal anchors, about
   ``2 / (window - k + 2)`` of all places).  Each batch of texts combines its
   anchors before the shuffle: an anchor that several of its texts hold is
   sent once.  Each bucket finds, for every anchor, the first holder of all.
   Anchors that only one document holds need no answer.
2. *Factors.*  A document extends a factor while successive anchors point to
   the same place of the same reference; as they overlap (``k`` is at least
   ``window - k + 1``), all words between are equal too.  Every run of
   ``window`` words inside a factor is a duplicate.
3. *Boundaries.*  Runs of words at the ends of factors, and those in documents
   that are an anchor's first holder, are compared by a 128-bit hash with all
   such runs of the corpus.  A run whose anchor stands in one document only can
   be neither a copy nor a source, and is not sent.
4. Spans from 2 and 3 return to their documents and are cut out.

Rows to a bucket are combined twice before the shuffle: within a batch, and by
a table of fixed size that a task keeps of what it has met (``Met``), so that a
passage which many documents share costs a few rows a task, not one a document:
whoever comes after a smaller holder in its task is answered there.  A bucket's
memory is bounded by the number of buckets, which follows the input's size.

Words are compared by 64-bit hashes, runs by 128-bit ones.

Rows: a null text has no words; a null id counts as larger than every id; rows
that share an id are never references for each other; repeated rows are each
kept, and share one answer.  Columns of the input pass through; result columns replace any of the
same name.  An empty table gives an empty result.  Texts count
whole, however long; one must fit a task's memory with its factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST_KEY, col, free, shuffle_width
from .textbatch import U64, Words, chunks, covered, end_task, ranges, runs_of, spans

WINDOW = 13
ANCHOR = 7

_BLOB = "bucket int, n int, hash binary, doc binary, place binary, ids binary, extra binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("hash", "doc", "place", "ids", "extra"))])


def anchors(words: Words, seed: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``window`` words the first place of the least ``seed``
    among its k-word runs, and whether the run lies inside one text."""
    w = window - k + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    best, at = seed[:n].copy(), np.zeros(n, np.int64)
    for o in range(1, w):
        less = seed[o : o + n] < best
        best[less] = seed[o : o + n][less]
        at[less] = o
    ok = words.doc_of()
    return np.arange(n) + at, ok[:n] == ok[window - 1 :]


class Met:
    """Hashes that a task has met with their least holder so far (key, version,
    place): one slot for each of 2**bits remainders.  What is lost when two
    hashes want a slot costs a row more, never an answer.  A hash that was met
    again yields its slot only after as many others wanted it."""

    def __init__(self, width: int, bits: int = 17):
        self.bits = bits
        self.hash = np.zeros((1 << bits, width), U64)
        self.holder = np.zeros((1 << bits, 3), np.int64)
        self.told = np.zeros(1 << bits, bool)
        self.worth = np.full(1 << bits, -1, np.int64)  # below 0: free

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of distinct hashes (rows of ``width``), and whether each is there."""
        slot = (hashes[:, 0] >> U64(64 - self.bits)).astype(np.int64)
        there = (self.worth[slot] >= 0) & (self.hash[slot] == hashes).all(1)
        self.worth[slot[there]] += 1
        return slot, there

    def put(self, hashes: np.ndarray, slot: np.ndarray, there: np.ndarray, holder: np.ndarray, told: np.ndarray) -> None:
        """Remember the holders of these hashes, where a slot is to be had."""
        other = ~there
        self.worth[slot[other]] -= 1
        ok = there | (self.worth[slot] < 0)
        ok &= np.bincount(slot, minlength=1 << self.bits)[slot] == 1  # of several new ones none, for a batch
        slot, again = slot[ok], there[ok]
        self.hash[slot], self.holder[slot] = hashes[ok], holder[ok]
        self.told[slot] = told[ok] | (again & self.told[slot])
        self.worth[slot] = np.where(again, self.worth[slot], 0)


def _blobs(bucket: np.ndarray, parts: list[np.ndarray], ids: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch | None:
    """One row for each bucket, holding what goes to it.  ``parts``: hash (of
    one or more values a row), text index, place; sorted by bucket."""
    if not len(bucket):
        return None
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(bucket))
    rows = [[], [], [], [], [], [], []]
    idb = ids.astype(np.int64)
    for a, b in zip(cut.tolist(), ends.tolist()):
        used, local = np.unique(parts[1][a:b], return_inverse=True)
        rows[0].append(int(bucket[a]))
        rows[1].append(b - a)
        rows[2].append(parts[0][a:b].tobytes())
        rows[3].append(local.astype(np.uint32).tobytes())
        rows[4].append(parts[2][a:b].astype(np.uint32).tobytes())
        rows[5].append(idb[used].tobytes())
        rows[6].append(b"" if extra is None else extra[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, _BLOB_ARROW.types)], schema=_BLOB_ARROW)


def _gather(table: pa.Table, width: int):
    """The rows of all blobs of a bucket: hash, id pair, place, extra."""
    hashes = np.frombuffer(b"".join(table["hash"].to_pylist()), U64).reshape(-1, width)
    places = np.frombuffer(b"".join(table["place"].to_pylist()), np.uint32).astype(np.int64)
    pairs = []
    for local, ids in zip(table["doc"].to_pylist(), table["ids"].to_pylist()):
        pairs.append(np.frombuffer(ids, np.int64).reshape(-1, 2)[np.frombuffer(local, np.uint32)])
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return hashes, pairs, places, b"".join(table["extra"].to_pylist())


def _index(text: str, key: str, version: str, buckets: int, window: int, k: int):
    """Batches of texts to anchors for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(1)
        for batch in batches:
            for part in chunks(batch, text):
                words = Words(part.column(part.schema.get_field_index(text)))
                if len(words) < window:
                    continue
                seed = runs_of(words.hashes(), k)
                at, whole = anchors(words, seed, window, k)
                at = np.unique(at[whole])
                if not len(at):
                    continue
                ids = np.stack([np.asarray(part.column(part.schema.get_field_index(x)), np.int64) for x in (key, version)], 1)
                doc = words.doc_of()[at]
                place, h = at - words.first[doc], seed[at]
                # The first holder within this batch comes first among equals.
                order = np.lexsort((place, ids[doc, 0], h))
                h, doc, place = h[order], doc[order], place[order]
                lead = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(h))))
                own = ids[doc, 0]
                holder = np.column_stack((ids[doc[lead]], place[lead]))
                slot, there = met.find(h[lead, None])
                before = there & (met.holder[slot, 0] < holder[:, 0])
                first = np.where(before[:, None], met.holder[slot], holder)
                later = own > first[group, 0]  # a smaller holder is known already
                # Later holders are answered here; the others ask, each for each
                # place in its document, and say whether anyone else is known.
                shared = np.zeros(len(lead), bool)
                np.logical_or.at(shared, group, later)
                ask = ~later
                tell = np.flatnonzero(before & shared & ~met.told[slot])  # on behalf of an earlier batch's holder
                met.told[slot[tell]] = True
                b = (np.concatenate((h[ask], h[lead[tell]])) % U64(buckets)).astype(np.int64)
                parts = [np.concatenate((h[ask], h[lead[tell]])), np.concatenate((doc[ask], len(ids) + np.arange(len(tell)))), np.concatenate((place[ask], first[tell, 2]))]
                extra = np.concatenate((shared[group][ask], np.ones(len(tell), bool))).astype(np.uint8)
                o = np.argsort(b, kind="stable")
                out = _blobs(b[o], [x[o] for x in parts], np.concatenate((ids, first[tell, :2])), extra[o])
                if out is not None:
                    yield out
                met.put(h[lead[~before], None], slot[~before], there[~before], holder[~before], shared[~before])
                if later.any():
                    extra = first[group[later]][:, [0, 2]]
                    b = np.full(len(extra), int(h[0] % U64(buckets)), np.int64)
                    out = _blobs(b, [np.zeros(len(extra), U64), doc[later], place[later]], ids, extra)
                    out = out.set_column(1, "n", pa.array((-np.asarray(out.column(1))).astype(np.int32)))
                    yield out
        end_task()

    return run


_ANSWER = pa.schema([("key", pa.int64()), ("version", pa.int64()), ("place", pa.int32()), ("ref", pa.int64()), ("ref_place", pa.int32())])


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each anchor that more than one document holds: its place, and its
    first holder (-1 as place where that is the document itself)."""
    n = np.asarray(table["n"])
    out = []
    settled, asked = table.filter(pa.array(n < 0)), table.filter(pa.array(n >= 0))
    if settled.num_rows:
        _, pairs, places, extra = _gather(settled, 1)
        ref = np.frombuffer(extra, np.int64).reshape(-1, 2)
        out.append((pairs, places, ref[:, 0], ref[:, 1]))
    if asked.num_rows:
        h, pairs, places, extra = _gather(asked, 1)
        shared = np.frombuffer(extra, np.uint8).astype(bool)
        order = np.lexsort((places, pairs[:, 0], h[:, 0]))
        h, pairs, places, shared = h[order, 0], pairs[order], places[order], shared[order]
        lead = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        sizes = np.diff(np.append(lead, len(h)))
        group = np.repeat(np.arange(len(lead)), sizes)
        first = pairs[lead, 0][group]
        many = np.logical_or.reduceat(shared | (pairs[:, 0] != first), lead)[group]
        ref_place = np.where(pairs[:, 0] > first, places[lead][group], -1)
        out.append((pairs[many], places[many], first[many], ref_place[many]))
    if not out:
        return _ANSWER.empty_table()
    pairs, places, ref, ref_place = (np.concatenate(x) for x in zip(*out))
    # Repeated rows share their answers.
    _, one = np.unique(np.column_stack((pairs, places, ref, ref_place)), axis=0, return_index=True) if len(pairs) else (None, np.zeros(0, np.int64))
    pairs, places, ref, ref_place = pairs[one], places[one], ref[one], ref_place[one]
    return pa.table([pairs[:, 0], pairs[:, 1], places.astype(np.int32), ref, ref_place.astype(np.int32)], schema=_ANSWER)


def _factor(text: str, key: str, version: str, found: str, buckets: int, window: int, k: int):
    """Batches of texts with their answers to spans inside factors (bucket -1
    rows) and to boundary runs for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(2)
        for batch in batches:
            for part in chunks(batch, text):
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                words = Words(get(text))
                ids = np.stack([np.asarray(get(x), np.int64) for x in (key, version)], 1)
                lists = get(found)
                sizes = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                place, ref, ref_place = (np.asarray(flat.field(i), np.int64) for i in range(3))
                n = len(words) - window + 1
                if n <= 0 or not len(doc):
                    continue
                # The best answer for each place: a reference, if there is one.
                at = words.first[doc] + place
                order = np.lexsort((ref, ref_place < 0, at))
                at, doc, ref, ref_place = at[order], doc[order], ref[order], ref_place[order]
                keep = np.diff(at, prepend=-1) != 0
                at, doc, ref, ref_place = at[keep], doc[keep], ref[keep], ref_place[keep]
                copied = ref_place >= 0
                # Greedy factors: as long as anchors follow each other in both.
                same = (copied[1:] & copied[:-1] & (doc[1:] == doc[:-1]) & (ref[1:] == ref[:-1])
                        & (at[1:] - at[:-1] == ref_place[1:] - ref_place[:-1]) & (at[1:] - at[:-1] <= k))
                begin = np.flatnonzero(np.concatenate(([True], ~same)) & copied)
                last = np.flatnonzero(np.concatenate((~same, [True])) & copied)
                a, b = at[begin], at[last] + k
                long = b - a >= window
                inside = np.zeros(n, bool)
                inside[ranges(a[long], (b - a - window + 1)[long])] = True
                # The other runs whose own anchor a second document holds; they
                # can be copies only if that anchor has a smaller holder.
                own, whole = anchors(words, runs_of(words.hashes(), k), window, k)
                state = np.zeros(len(words), np.int8)
                state[at] = 1 + copied
                texts = words.doc_of()
                send = np.flatnonzero(whole & (state[own] > 0) & ~inside)
                query = state[own[send]] == 2
                if len(send):
                    both = np.stack([runs_of(words.hashes(i), window, i)[send] for i in (0, 1)], 1)
                    owner = ids[texts[send], 0]
                    order = np.lexsort((send, owner, both[:, 1], both[:, 0]))
                    send, query, both, owner = send[order], query[order], both[order], owner[order]
                    new = np.concatenate(([True], (both[1:] != both[:-1]).any(1)))
                    lead = np.flatnonzero(new)
                    group = np.cumsum(new) - 1
                    slot, there = met.find(both[lead])
                    before = there & (met.holder[slot, 0] < owner[lead])
                    first = np.where(before, met.holder[slot, 0], owner[lead])
                    later = owner > first[group]
                    inside[send[later]] = True
                    fresh = np.flatnonzero(~before)
                    met.put(both[lead[fresh]], slot[fresh], there[fresh], np.column_stack([owner[lead[fresh]]] * 3), np.zeros(len(fresh), bool))
                    # Of the first document, all that ask, or else one row.
                    asks = np.zeros(len(lead), bool)
                    np.logical_or.at(asks, group, query & ~later)
                    stay = ~later & (query | (new & ~asks[group]))  # none of a group with an earlier holder
                    h, s, q = both[stay], send[stay], query[stay]
                    bucket = (h[:, 0] % U64(buckets)).astype(np.int64)
                    o = np.argsort(bucket, kind="stable")
                    out = _blobs(bucket[o], [h[o], texts[s][o], (s - words.first[texts[s]])[o]], ids, q[o].astype(np.uint8))
                    if out is not None:
                        yield out
                if inside.any():
                    # Consecutive runs of one text form one span.
                    i = np.flatnonzero(inside)
                    cut = np.flatnonzero(np.concatenate(([True], (np.diff(i) > 1) | (texts[i[1:]] != texts[i[:-1]]))))
                    start, stop = i[cut], i[np.append(cut[1:], len(i)) - 1] + window
                    d = texts[start]
                    spot = int((U64(int(ids[d[0], 1]) & (2**63 - 1))) % U64(buckets))
                    out = _blobs(np.full(len(d), spot, np.int64), [np.zeros((len(d), 2), U64), d, start - words.first[d]], ids, (stop - words.first[d]).astype(np.uint32))
                    yield out.set_column(1, "n", pa.array((-np.asarray(out.column(1))).astype(np.int32)))
        end_task()

    return run


_SPAN = pa.schema([("key", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _answer_runs(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans found inside factors, and boundary runs that a smaller
        document holds too."""
        n = np.asarray(table["n"])
        out = []
        settled, asked = table.filter(pa.array(n < 0)), table.filter(pa.array(n >= 0))
        if settled.num_rows:
            _, pairs, places, extra = _gather(settled, 2)
            out.append((pairs, places, np.frombuffer(extra, np.uint32).astype(np.int64)))
        if asked.num_rows:
            h, pairs, places, extra = _gather(asked, 2)
            asks = np.frombuffer(extra, np.uint8).astype(bool)
            order = np.lexsort((pairs[:, 0], h[:, 1], h[:, 0]))
            h, pairs, places, asks = h[order], pairs[order], places[order], asks[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]).any(1)))
            first = pairs[np.flatnonzero(new), 0][np.cumsum(new) - 1]
            hit = asks & (pairs[:, 0] > first)
            out.append((pairs[hit], places[hit], places[hit] + window))
        if not out:
            return _SPAN.empty_table()
        pairs, start, stop = (np.concatenate(x) for x in zip(*out))
        _, one = np.unique(np.column_stack((pairs, start, stop)), axis=0, return_index=True) if len(pairs) else (None, np.zeros(0, np.int64))
        pairs, start, stop = pairs[one], start[one], stop[one]
        return pa.table([pairs[:, 0], pairs[:, 1], start.astype(np.int32), stop.astype(np.int32)], schema=_SPAN)

    return run


def _cut(text: str, found: str, names: list[str], out: pa.Schema):
    """Texts and their spans to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                words = Words(get(text))
                lists = get(found)
                sizes = np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid())
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                start, stop = (np.asarray(flat.field(i), np.int64) + words.first[doc] for i in range(2))
                drop = covered(len(words), start, stop) if len(doc) else np.zeros(len(words), bool)
                total = np.concatenate(([0], np.cumsum(drop)))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                # Kept words, each with one space before it but the first of a text.
                kept = ~drop
                s, e = words.start[kept], words.end[kept]
                before = np.concatenate(([0], np.cumsum(kept)))[words.first]
                length = e - s + 1
                take = ranges(s - 1, length)
                at = np.concatenate(([0], np.cumsum(length)))
                spaced = words.buf[np.maximum(take, 0)].copy() if len(take) else np.zeros(0, np.uint8)
                spaced[at[:-1]] = 32
                bounds = at[before]
                joined = [spaced[a + 1 : b].tobytes() if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                merged = []
                for d in range(part.num_rows):
                    a, b = words.first[d], words.first[d + 1]
                    x, y = spans(drop[a:b]) if removed[d] else ((), ())
                    merged.append([{"start": int(i), "stop": int(j)} for i, j in zip(x, y)])
                more = [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, pa.binary()).cast(out.field("kept_text").type), pa.array(merged, out.field("duplicate_spans").type)]
                yield pa.RecordBatch.from_arrays([*(get(x) for x in names), *more], schema=out_schema(part, names, out))

    return run


def out_schema(part: pa.RecordBatch, names: list[str], out: pa.Schema) -> pa.Schema:
    return pa.schema([*(part.schema.field(x) for x in names), *out])


_MADE = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                   ("duplicate_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_MADE_SQL = "n_words long, n_removed long, kept_text string, duplicate_spans array<struct<start:int,stop:int>>"


def remove_duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Cut every word that lies in a run of ``window`` words which also stands
    in a document with a smaller id; runs are judged on the input.

    Adds ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one
    space) and ``duplicate_spans`` (half-open word ranges).
    """
    if not 0 < anchor <= window or anchor < window - anchor + 1:
        raise ValueError("anchor words must overlap: 2 * anchor must exceed window")
    base = docs.drop("n_words", "n_removed", "kept_text", "duplicate_spans")
    key, version, found = free(base, "row_key", "row_version", "found")
    width = shuffle_width(base)
    buckets = 2 * width
    keyed = base.withColumns({key: F.coalesce(col(id_col).cast("long"), F.lit(LAST_KEY)), version: F.xxhash64(col(text_col))})

    slim = keyed.select(F.col(key), F.col(version), col(text_col).alias("text"))
    asked = slim.mapInArrow(_index("text", key, version, buckets, window, anchor), _BLOB)
    answers = asked.repartition(width, "bucket").groupBy("bucket").applyInArrow(_answer_anchors, "key long, version long, place int, ref long, ref_place int")
    by_doc = answers.groupBy("key", "version").agg(F.collect_set(F.struct("place", "ref", "ref_place")).alias(found))
    by_doc = by_doc.withColumnsRenamed({"key": key, "version": version})
    passes = keyed.schema
    passed = base.columns
    # Both joins deal the same columns out by the same key: one exchange serves both.
    runs = keyed.join(by_doc, [key, version], "inner").mapInArrow(_factor(text_col, key, version, found, buckets, window, anchor), _BLOB)
    cuts = runs.repartition(width, "bucket").groupBy("bucket").applyInArrow(_answer_runs(window), "key long, version long, start int, stop int")
    cuts = cuts.groupBy("key", "version").agg(F.collect_set(F.struct("start", "stop")).alias(found))
    cuts = cuts.withColumnsRenamed({"key": key, "version": version})
    full = keyed.join(cuts, [key, version], "left")
    result = T.StructType([f for f in passes if f.name in passed] + list(T._parse_datatype_string(_MADE_SQL)))
    return full.mapInArrow(_cut(text_col, found, passed, _MADE), result)


def op2_query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, from the operator's output."""
    from .common import table

    out = remove_duplicate_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows: windows as strings of 13 words (words hold no spaces).
OP2_SQL = r"""
WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS d FROM wins GROUP BY k HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM wins JOIN firsts USING (k) WHERE doc_id > d),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS s FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
