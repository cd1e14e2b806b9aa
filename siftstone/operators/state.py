"""Upserts, deletes, retention over keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("x")
    return rows.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in rows.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest(table.unionByName(changes), keys, order)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def retain(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; future rows stay."""
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def newest(rows: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The n newest rows (a top-k, not a sort of everything)."""
    return rows.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
