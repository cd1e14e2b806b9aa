"""Streaming pipelines: each works on a streaming frame, and on a batch frame
with the same result where it has no state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "7 days"


def timed(events: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Event time as a timestamp, with a watermark on streams."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if events.isStreaming else out


def unseen(events: DataFrame, key: str = "id") -> DataFrame:
    """The first item of each id while the watermark keeps its state."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window and key."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", key: str = "user_id") -> DataFrame:
    """Sessions of a user's events, closed by a gap."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def split_late(events: DataFrame, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """Items within retention, and late ones for a dead-letter sink."""
    limit = as_of - F.make_dt_interval(F.lit(days))
    return events.where(F.col("ts") >= limit), events.where(F.col("ts") < limit)


def running_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Per-user event counts and last types as custom state, updated by batch."""
    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        last_ts = None
        for pdf in batches:
            n += len(pdf)
            newest = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if last_ts is None or newest["ts"] >= last_ts:
                last_ts, last = newest["ts"], newest["event_type"]
        state.update((n, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "last_type": [last]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, last_type string", "n long, last string", "update", "NoTimeout")


def session_state(turns: DataFrame, recent: int = 5) -> DataFrame:
    """State of each (user_id, session_id) of a stream of turns (with ``turn``,
    ``cited`` and ``entity``, which may be null): turns so far, and the last
    cited sources and entities, oldest first, each once, by its latest mention."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, cited, entities = state.get if state.exists else (0, [], [])
        cited, entities = list(cited), list(entities)
        for pdf in batches:
            pdf = pdf.sort_values("turn", kind="stable")
            n += len(pdf)
            for held, column in ((cited, "cited"), (entities, "entity")):
                for x in pdf[column].dropna():
                    if x in held:
                        held.remove(x)
                    held.append(x)
                del held[:-recent]
        state.update((n, cited, entities))
        yield pd.DataFrame({"user_id": [key[0]], "session_id": [key[1]], "turns": [n], "cited": [cited], "entities": [entities]})

    out = "user_id long, session_id long, turns long, cited array<string>, entities array<string>"
    return turns.groupBy("user_id", "session_id").applyInPandasWithState(update, out, "turns long, cited array<string>, entities array<string>", "update", "NoTimeout")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what there is, batch by batch, and stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def notify(items: DataFrame, send: Callable[[DataFrame], None]) -> None:
    """Hand over the items that are not duplicates, in a foreachBatch."""
    send(items.where(~F.col("is_duplicate")))


class NearDuplicateSink:
    """foreachBatch sink: flags items near any earlier one, and keeps two tables
    that grow by appends, by batch: the bands of all items, 24 bytes each, and
    their signatures.

    Only the bands are read for a batch, and the signatures of what shares one
    with it.  ``keep`` batches are looked back on (all, if None); older ones are
    neither read nor kept.  A retried batch replaces its own rows.  Of equal
    items in one batch the least id is the first.
    """

    def __init__(self, path: str, threshold: float = 0.8, keep: int | None = None):
        self.path, self.threshold, self.keep = path, threshold, keep

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _expire(self, spark: SparkSession, number: int) -> None:
        for name in ("bands", "signatures"):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={number - self.keep - 1}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def __call__(self, batch: DataFrame, number: int) -> None:
        from siftstone.functions.vectors import equal_share
        from siftstone.operators import dedup

        spark = batch.sparkSession
        signed = self._write(dedup.signatures(batch.select(F.col("id"), F.col("content")), "id", "content").withColumn("batch", F.lit(number)), "signatures")
        bands = self._write(signed.where(F.col("batch") == number).select("id", F.explode(dedup.buckets(F.col("signature"))).alias("bucket"), "batch"), "bands")
        held = F.col("batch") <= number
        if self.keep is not None:
            held = held & (F.col("batch") >= number - self.keep)
        new = bands.where(F.col("batch") == number).select(F.col("id").alias("n"), "bucket")
        old = bands.where(held).select(F.col("id").alias("o"), F.col("batch").alias("ob"), "bucket")
        pairs = new.join(old, "bucket").where((F.col("ob") < number) | (F.col("o") < F.col("n"))).select("n", "o", "ob").distinct()
        mine = signed.where(F.col("batch") == number).select(F.col("id").alias("n"), F.col("signature").alias("sn"))
        theirs = signed.where(held).select(F.col("id").alias("o"), F.col("batch").alias("ob"), F.col("signature").alias("so"))
        scored = pairs.join(theirs, ["o", "ob"]).join(mine, "n")
        scored = scored.withColumn("similarity", F.round(equal_share(F.col("sn"), F.col("so")), 6)).where(F.col("similarity") >= self.threshold)
        best = scored.groupBy(F.col("n").alias("id")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("o"))).alias("x")).select("id", F.col("x.o").alias("duplicate_of"))
        out = batch.join(best, "id", "left").withColumns({"is_duplicate": F.col("duplicate_of").isNotNull(), "batch": F.lit(number)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/items")
        if self.keep is not None:
            self._expire(spark, number)
