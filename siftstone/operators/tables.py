"""A small relational engine over extracted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import pad_row, squeeze

_COMPARE = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "contains": lambda c, v: F.coalesce(c.cast("string"), F.lit("")).rlike(f"(?i){v}"),
}
_AGGREGATE = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(F.lit(1)), "unique": F.countDistinct,
}


def predicate(column: str, op: str, value) -> Column:
    """One comparison; ``contains`` is a case-insensitive regular expression."""
    if op not in _COMPARE:
        raise ValueError(f"unknown operator: {op}")
    return _COMPARE[op](F.col(column), value)


def aggregate(column: str, how: str) -> Column:
    """sum, mean, min, max, count (rows, nulls too) or unique (without nulls)."""
    if how not in _AGGREGATE:
        raise ValueError(f"unknown aggregate: {how}")
    return _AGGREGATE[how](F.col(column))


class TableQuery:
    """Chained select, filter, sort, head, aggregate, describe."""

    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *columns: str) -> TableQuery:
        return TableQuery(self.df.select(*columns))

    def filter(self, column: str, op: str, value) -> TableQuery:
        return TableQuery(self.df.where(predicate(column, op, value)))

    def sort(self, column: str, ascending: bool = True, *ties: str) -> TableQuery:
        key = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
        return TableQuery(self.df.orderBy(key, *ties))

    def head(self, n: int = 5) -> TableQuery:
        return TableQuery(self.df.limit(n))

    def aggregate(self, column: str, how: str, *group: str) -> DataFrame:
        return self.df.groupBy(*group).agg(aggregate(column, how).alias(f"{how}_{column}"))

    def rollup(self, column: str, how: str, *group: str) -> DataFrame:
        return self.df.rollup(*group).agg(aggregate(column, how).alias(f"{how}_{column}"))

    def lookup(self, column: str, value) -> TableQuery:
        """Rows with exactly that value."""
        return self.filter(column, "==", value)

    def describe(self) -> dict:
        return {"rows": self.df.count(), "columns": self.df.columns, "sample": [r.asDict() for r in self.df.limit(3).collect()]}


def convert_cell(cell: Column) -> Column:
    """A cell's text without comma, dollar and percent signs."""
    return F.trim(F.regexp_replace(squeeze(cell), "[,$%]", ""))


def cell_type(cell: Column) -> Column:
    """double, bigint or string, cell by cell: digits with a point are doubles,
    digits are integers, all else (also exponents) stays text."""
    bare = convert_cell(cell)
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), "double").when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), "bigint").otherwise("string")


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the type that all of its cells have.  One pass
    decides, one converts."""
    kinds = df.select(*(cell_type(F.col(f"`{c}`")).alias(c) for c in df.columns))
    found = kinds.agg(*(F.collect_set(f"`{c}`").alias(c) for c in df.columns)).first()
    out = []
    for c in df.columns:
        have = set(found[c])
        bare = F.regexp_replace(convert_cell(F.col(f"`{c}`")), "_", "")
        if have == {"bigint"}:
            out.append(bare.cast("bigint").alias(c))
        elif have and have <= {"bigint", "double"}:
            out.append(bare.cast("double").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def chunk_table(rows: DataFrame, row_idx: str = "row_idx", size: int = 50, *keys: str) -> DataFrame:
    """Chunks of ``size`` rows with their first, last and total row counts."""
    from pyspark.sql.window import Window

    chunk = F.floor(F.col(row_idx) / size).cast("bigint")
    parts = rows.groupBy(*keys, chunk.alias("chunk_index")).agg((F.min(row_idx)).alias("start_row"), (F.max(row_idx) + 1).alias("end_row"), F.count(F.lit(1)).alias("n_rows"))
    return parts.withColumn("total_rows", F.sum("n_rows").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))


def fit_rows(rows: Column, width: int) -> Column:
    return F.transform(rows, lambda r: pad_row(r, width))
