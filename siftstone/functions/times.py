"""Time columns: decay, freshness, retention.  "Now" is always a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of similarity, time and priority in a time-weighted score.
WEIGHTS = (0.6, 0.3, 0.1)
HALF_LIFE_H, MAX_AGE_H, BOOST, BOOST_H = 24.0, 720.0, 1.5, 1.0


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6


def time_score(ts: Column, as_of: Column, decay: str = "exponential", half_life_h: float = HALF_LIFE_H, max_age_h: float = MAX_AGE_H) -> Column:
    """Decay by age; items of the last hour (future ones too) are boosted, and
    the result is at most 1.  An unknown decay gives 1."""
    hours = age_seconds(ts, as_of) / 3600
    aged = F.greatest(hours, F.lit(0.0))
    if decay == "exponential":
        score = F.exp(-math.log(2) / half_life_h * hours)
    elif decay == "linear":
        score = F.greatest(F.lit(0.0), 1 - hours / max_age_h)
    elif decay == "logarithmic":
        score = 1 / (1 + F.log1p(aged / half_life_h))
    else:
        score = F.lit(1.0)
    return F.least(F.when(hours <= BOOST_H, score * BOOST).otherwise(score), F.lit(1.0))


def combined_score(similarity: Column, time: Column, priority: Column, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    return weights[0] * similarity + weights[1] * time + weights[2] * priority / 5


def freshness(ts: Column, as_of: Column) -> Column:
    """How old the newest item is, in words."""
    age = age_seconds(ts, as_of)

    def ago(unit: str, seconds: int) -> Column:
        n = F.floor(age / seconds)
        return F.concat(F.lit("As of "), n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return (F.when(ts.isNull(), "No recent data available").when(age < 60, "Based on data from the last minute")
            .when(age < 3600, ago("minute", 60)).when(age < 86400, ago("hour", 3600))
            .otherwise(F.concat(F.lit("As of "), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))))


def freshness_label(ts: Column, as_of: Column) -> Column:
    age = age_seconds(ts, as_of)

    def ago(unit: str, seconds: int) -> Column:
        n = F.floor(age / seconds)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(age < 60, "Just now").when(age < 3600, ago("minute", 60)).when(age < 86400, ago("hour", 3600)).otherwise(ago("day", 86400))


def clock(operation: str, as_of: Column, zone: str = "UTC") -> Column:
    """now, date, time, weekday or timestamp of an instant in a zone."""
    local = F.from_utc_timestamp(as_of, zone)
    kinds = {"now": F.date_format(local, "yyyy-MM-dd HH:mm:ss"), "date": F.date_format(local, "yyyy-MM-dd"), "time": F.date_format(local, "HH:mm:ss"),
             "weekday": F.date_format(local, "EEEE"), "timestamp": F.unix_seconds(as_of).cast("string")}
    if operation not in kinds:
        raise ValueError(f"unknown date operation: {operation}")
    return kinds[operation]
