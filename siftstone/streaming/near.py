"""Near duplicates of a stream, by keyed state that expires.

Items are signed row by row and dealt out by the buckets of their bands; the state of
a bucket is a map from (time, id) to signature, in the state store of the cluster (it
needs the RocksDB provider).  An item is told its earliest like within ``keep`` before
it.  Each entry sets a timer for when nothing can match it any more: its time and
``keep``, in event time, so the watermark decides, and late items that the watermark
lets through find what an orderly stream would have shown them.  A late item is also told
to the items after it that are held.

Copies with one signature are compared once.  They still stand in the state one by one;
``pipelines.unseen`` before this stage keeps floods of exact copies out of it.

On tables the same rule needs no state: a bucket is cut into slices of time, each with the
items just before it as guests, so that a group holds ``SPAN + 1`` times ``keep`` of one
bucket however long the table is.  Only items with another one near them in time stay, and a
signature goes once to each group of several signatures where it stands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from siftstone.functions.lineage import kept
from siftstone.operators import dedup

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MATCH = "id long, ts timestamp, duplicate_of long, original_ts timestamp, similarity double"
#: Length of a table's slices of time, in times of ``keep``.
SPAN = 4
GROUP = ("bucket", "slice")
KIND = ("k1", "k2")


class Bands(StatefulProcessor):
    """The state of a bucket; times are microseconds."""

    def __init__(self, threshold: float, keep: int):
        self.threshold, self.keep = threshold, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, id long", "signature array<long>")

    def _due(self, at: int) -> int:
        """Milliseconds at which an item is past; in steps, so that timers are shared."""
        step = max(1, self.keep // 8000)
        return (at + self.keep) // 1000 // step * step + step

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries: dict[bytes, list[tuple[int, int]]] = {}
        for (at, i), (signature,) in self.held.iterator():
            insort(entries.setdefault(np.asarray(signature, np.int64).tobytes(), []), (at, i))
        known = [np.frombuffer(s, np.int64) for s in entries]
        stack, names = (np.stack(known) if known else None), list(entries)
        out = []
        for pdf in rows:
            for i, at, signature in zip(pdf["id"], pdf["micros"], pdf["signature"]):
                own, me = np.asarray(signature, np.int64), (int(at), int(i))
                if own.tobytes() not in entries:
                    entries[own.tobytes()] = []
                    names.append(own.tobytes())
                    stack = own[None, :] if stack is None else np.vstack((stack, own))
                like = np.floor((stack == own).mean(1) * 1e6 + 0.5) / 1e6  # halves go up, as in SQL
                best = None
                for n in np.flatnonzero(like >= self.threshold):
                    there = entries[names[n]]
                    p = bisect_left(there, (me[0] - self.keep, -(2**63)))
                    if p < len(there) and there[p] < me and (best is None or there[p] < best[0]):
                        best = there[p], like[n]
                    # What came before this late item, but stands after it.
                    for after in there[bisect_left(there, (*me[:1], me[1] + 1)) :]:
                        if after[0] - self.keep > me[0]:
                            break
                        out.append((after, me, like[n]))
                if best is not None:
                    out.append((me, *best))
                if me not in entries[own.tobytes()]:
                    insort(entries[own.tobytes()], me)
                    self.held.updateValue(me, (own.tolist(),))
                    self.handle.registerTimer(self._due(me[0]))
        when = lambda x: pd.to_datetime(np.array(x, np.int64), unit="us")
        yield pd.DataFrame({"id": np.array([a[1] for a, _, _ in out], np.int64), "ts": when([a[0] for a, _, _ in out]), "duplicate_of": np.array([b[1] for _, b, _ in out], np.int64),
                            "original_ts": when([b[0] for _, b, _ in out]), "similarity": np.array([s for *_, s in out], float)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for entry in [k for k, _ in self.held.iterator() if k[0] + self.keep < now]:
            self.held.removeKey(entry)
        yield pd.DataFrame({"id": np.array([], np.int64), "ts": pd.to_datetime([]), "duplicate_of": np.array([], np.int64), "original_ts": pd.to_datetime([]), "similarity": np.array([], float)})

    def close(self) -> None:
        pass


def _earliest(at: np.ndarray, ids: np.ndarray, kind: np.ndarray, own: np.ndarray, stack: np.ndarray | None, keep: int, threshold: float) -> list[tuple[int, int, float]]:
    """(row, earlier row, similarity) of one group in order of time and id, for its own
    rows; ``stack`` has the signatures by kind, or is None where all rows have the same."""
    new = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]
    before = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))  # where the rows of this time and id begin
    since = np.searchsorted(at, at - keep)
    mine = np.flatnonzero(own & (since < before))
    out = []
    for some in np.split(m := mine[np.argsort(kind[mine], kind="stable")], np.flatnonzero(np.diff(kind[m])) + 1):
        if len(some):
            like = np.ones(1) if stack is None else np.floor((stack == stack[kind[some[0]]]).mean(1) * 1e6 + 0.5) / 1e6  # halves go up, as in SQL
            there = np.r_[np.flatnonzero((like >= threshold)[kind]), len(at)]
            out += [(x, y, like[kind[y]]) for x, y in zip(some, there[np.searchsorted(there, since[some])]) if y < before[x]]
    return out


def _matched(keep: int, threshold: float):
    """Matches of rows sorted by group, its signatures before its items."""

    def of(group: pa.Table) -> list[tuple[int, int, int, int, float]]:
        told = group.column("signature").combine_chunks()
        signs = len(told) - told.null_count
        names = np.stack([group.column(k).to_numpy() for k in KIND], 1)
        kinds, kind = np.unique(names, axis=0, return_inverse=True)
        kind, stack = kind.reshape(-1), None
        if len(kinds) > 1:
            stack = np.empty((len(kinds), len(told[0])), np.int32)
            stack[kind[:signs]] = told.slice(0, signs).flatten().to_numpy().reshape(signs, -1)
        at, ids, own = (group.column(c).slice(signs).to_numpy() for c in ("micros", "id", "own"))
        return [(ids[x], at[x], ids[y], at[y], s) for x, y, s in _earliest(at, ids, kind[signs:], own, stack, keep, threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in GROUP], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            if rest and any(rest[0].column(c)[0] != batch.column(c)[0] for c in GROUP):
                yield _rows(of(pa.Table.from_batches(rest)))
                rest = []
            found = []
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                found += of(pa.Table.from_batches([*rest, batch.slice(a, b - a)]))
                rest = []
            rest.append(batch.slice(cuts[-2]))
            yield _rows(found)
        if rest:
            yield _rows(of(pa.Table.from_batches(rest)))

    return run


def _rows(found: list[tuple[int, int, int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.float64()) for i, c in enumerate(columns)], ["id", "micros", "duplicate_of", "original", "similarity"])


def _of_table(signed: DataFrame, keep: int, threshold: float) -> DataFrame:
    """``near_matches`` of a table of (id, micros, signature)."""
    names = (F.xxhash64("signature"), F.xxhash64(F.lit(1), F.reverse("signature")))  # together 128 bits
    signed = kept(signed.select("id", "micros", F.col("signature").cast("array<int>").alias("signature"), dedup.buckets(F.col("signature")).alias("buckets"), *(x.alias(k) for x, k in zip(names, KIND))))
    span = max(1, keep) * SPAN
    here = F.expr(f"(micros - pmod(micros, {span}L)) div {span}L")
    on = F.expr(f"if(pmod(micros, {span}L) >= {span - keep}L, array(0, 1), array(0))")  # late ones are looked back on from the next slice
    dealt = signed.select("id", "micros", *KIND, F.explode("buckets").alias("bucket")).withColumn("on", F.explode(on)).select("bucket", (here + F.col("on")).alias("slice"), (F.col("on") == 0).alias("own"), "id", "micros", *KIND)
    group, order = Window.partitionBy(*GROUP), Window.partitionBy(*GROUP).orderBy("micros", "id", *KIND)
    apart = lambda x: F.coalesce(x <= keep, F.lit(False))
    stays = F.max("own").over(group) & (apart(F.col("micros") - F.lag("micros").over(order)) | apart(F.lead("micros").over(order) - F.col("micros")))
    items = kept(dealt.withColumn("stays", stays).where("stays").drop("stays"))
    kinds = items.groupBy(*GROUP, *KIND).agg(F.min(F.struct("micros", "id")).alias("x")).select(*GROUP, *KIND, "x.micros", "x.id")
    several = items.groupBy(*GROUP).agg(*(F.min(k) != F.max(k) for k in KIND)).toDF(*GROUP, "a", "b").where("a or b").select(*GROUP)
    told = kinds.join(several, [*GROUP]).join(signed.select("id", "micros", *KIND, "signature"), ["id", "micros", *KIND])
    rows = items.unionByName(told.select(*GROUP, *KIND, "signature"), allowMissingColumns=True).repartition(*GROUP).sortWithinPartitions(*GROUP, F.col("signature").isNull(), "micros", "id", *KIND)
    found = rows.mapInArrow(_matched(keep, threshold), "id long, micros long, duplicate_of long, original long, similarity double")
    return found.select("id", F.timestamp_micros("micros").alias("ts"), "duplicate_of", F.timestamp_micros("original").alias("original_ts"), "similarity")


def near_matches(items: DataFrame, keep: str, threshold: float = dedup.THRESHOLD, delay: str = "1 hour") -> DataFrame:
    """(id, ts, duplicate_of, original_ts, similarity), a row for each bucket that an
    item shares with its earliest like there; ``first_matches`` folds them.  ``items`` has
    id, ts and content.  On a stream ``delay`` is the watermark's."""
    spark = items.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {keep}) AS n").first().n
    timed = items.select(F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "content").where("id is not null and ts is not null")
    signed = dedup.signatures(timed.select(F.struct("id", "ts").alias("item"), "content"), "item", "content")
    signed = signed.select("id.id", "id.ts", F.unix_micros("id.ts").alias("micros"), "signature")
    if not items.isStreaming:
        return _of_table(signed, micros, threshold)
    dealt = signed.select("id", "ts", "micros", "signature", F.explode(dedup.buckets(F.col("signature"))).alias("bucket")).withWatermark("ts", delay)
    return dealt.groupBy("bucket").transformWithStateInPandas(Bands(threshold, micros), MATCH, "append", "eventTime")


def first_matches(matches: DataFrame) -> DataFrame:
    """(id, duplicate_of, similarity): each item's earliest original."""
    best = F.min(F.struct("original_ts", "duplicate_of", "similarity")).alias("x")
    return matches.groupBy("id").agg(best).select("id", "x.duplicate_of", "x.similarity")
