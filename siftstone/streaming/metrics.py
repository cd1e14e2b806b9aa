"""What passes through a pipeline, counted as it runs.

Steps of a batch carry observations: aggregates that the job itself computes, so that no
table is read twice for its counts.  A stream's steps are observed under names; its
listener turns every batch's progress into rows of a step table, errors too, a few rows
a batch, appended by the driver.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STEPS = "query string, batch long, step string, metric string, value double, at timestamp"


def counted(**more: Column) -> list[Column]:
    """Rows, and further aggregates by name."""
    return [F.count(F.lit(1)).alias("rows"), *(c.cast("double").alias(n) for n, c in more.items())]


class StepLog:
    """Observed steps of one batch job: ``step`` marks a frame, and once a job has run over
    it, ``table`` has its rows (place, step, metric, value)."""

    def __init__(self):
        self.steps: list[tuple[str, Observation]] = []

    def step(self, name: str, df: DataFrame, **more: Column) -> DataFrame:
        seen = Observation(name)
        self.steps.append((name, seen))
        return df.observe(seen, *counted(**more))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, name, metric, None if v is None else float(v)) for n, (name, seen) in enumerate(self.steps) for metric, v in seen.get.items()]
        return spark.createDataFrame(rows, "place int, step string, metric string, value double")


def observed(stream: DataFrame, step: str, **more: Column) -> DataFrame:
    """A stream's step, for ``IngestListener``."""
    return stream.observe(step, *counted(**more))


class IngestListener(StreamingQueryListener):
    """Writes, for each batch of the named queries (all, if none are named), the observed
    metrics, the rows read and the milliseconds of each phase to a table at ``path``; and a
    row for a query that fails."""

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] = ()):
        self.spark, self.path, self.names = spark, path, names
        self.known: dict[str, str | None] = {}

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.known[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names and p.name not in self.names:
            return
        at, name = datetime.now(timezone.utc), p.name or str(p.id)
        rows = [(name, p.batchId, "batch", "input_rows", float(p.numInputRows), at), *((name, p.batchId, "batch", f"{k}_ms", float(v), at) for k, v in p.durationMs.items())]
        for step, values in p.observedMetrics.items():
            rows += [(name, p.batchId, step, metric, None if v is None else float(v), at) for metric, v in values.asDict().items()]
        self._write(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.known.pop(str(event.id), None)
        if event.exception and (not self.names or name in self.names):
            self._write([(name or str(event.id), -1, "query", "failed", 1.0, datetime.now(timezone.utc))])


def totals(steps: DataFrame) -> DataFrame:
    """(query, step, metric, value): sums over the batches; a batch that was reported twice counts once."""
    once = steps.groupBy("query", "batch", "step", "metric").agg(F.max_by("value", "at").alias("value"))
    return once.groupBy("query", "step", "metric").agg(F.sum("value").alias("value"))
