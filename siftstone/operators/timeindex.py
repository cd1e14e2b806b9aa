"""Search over timed items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.times import combined_score, time_score
from siftstone.operators.retrieval import top_k


def in_range(items: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Inclusive at both ends."""
    return items.where(F.col(ts).between(start, end))


def select_items(items: DataFrame, kinds: Sequence[str] = (), sources: Sequence[str] = (), since: Column | None = None, duplicates: bool = True) -> DataFrame:
    """Filters before any top-k, so that they reach the scan."""
    if kinds:
        items = items.where(F.col("kind").isin(*kinds))
    if sources:
        items = items.where(F.col("source").isin(*sources))
    if since is not None:
        items = items.where(F.col("ts") >= since)
    if not duplicates:
        items = items.where(~F.col("is_duplicate"))
    return items


def time_weighted(items: DataFrame, as_of: Column, k: int, decay: str = "exponential") -> DataFrame:
    """Needs id, ts, similarity and priority (1 to 5)."""
    timed = items.withColumn("time_score", F.round(time_score(F.col("ts"), as_of, decay), 6))
    scored = timed.withColumn("score", F.round(combined_score(F.col("similarity"), F.col("time_score"), F.col("priority")), 6))
    return top_k(scored, k)


def substring_search(items: DataFrame, text: str, phrase: str, as_of: Column, k: int) -> DataFrame:
    """Fallback without vectors: items that contain the phrase, 0.5 plus 0.3 of the time score."""
    hits = items.where(F.contains(F.lower(F.col(text)), F.lit(phrase.lower())))
    return top_k(hits.withColumn("score", F.round(0.5 + 0.3 * time_score(F.col("ts"), as_of), 6)), k)
