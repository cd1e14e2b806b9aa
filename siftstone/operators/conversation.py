"""Dialogue turns, memory and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_turns(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation, newest first as ``recency`` 1."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return turns.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def history(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Beside each turn the n turns before it, as one text."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    said = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(said).over(w), "\n"))


def recent(turns: DataFrame, column: str, n: int, name: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n values of a column before each turn, oldest first.  Frames are of n
    rows that have a value; a turn takes the last of these that came before it."""
    there = F.col(column).isNotNull()
    upto = F.collect_list(column).over(Window.partitionBy(key, there).orderBy(order).rowsBetween(1 - n, 0))
    held = f"{name}_upto"
    out = turns.withColumn(held, F.when(there, upto))
    last = F.last(held, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast(turns.select(F.array(column)).schema[0].dataType)
    return out.withColumn(name, F.coalesce(last, none)).drop(held)


def every(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns at which a periodic task is due."""
    return turns.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("number") % n == 0)


def citations(hits: DataFrame, keys: list[str], source: str, order: list[str]) -> DataFrame:
    """Number sources in order of first use within each answer."""
    first = hits.groupBy(*keys, source).agg(F.min(F.struct(*order)).alias("o"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("o", source))).drop("o")
    return hits.join(numbered, [*keys, source])


def preferences(log: DataFrame) -> DataFrame:
    """Latest value of each (user_id, key)."""
    return log.groupBy("user_id", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def memory_context(prefs: DataFrame, facts: DataFrame, documents: DataFrame, most_facts: int = 5, most_docs: int = 3) -> DataFrame:
    """(user_id, context): preferences, newest facts, newest documents."""
    def newest(df, column, n, label):
        w = Window.partitionBy("user_id").orderBy(F.col("at").desc(), column)
        top = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
        return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(column).alias("v")))), lambda x: x["v"]), "; ").alias(label))

    p = prefs.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), "; ").alias("p"))
    out = p.join(newest(facts, "fact", most_facts, "f"), "user_id", "full_outer").join(newest(documents, "title", most_docs, "d"), "user_id", "full_outer")
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    return out.select("user_id", F.concat_ws("\n", part("Preferences", "p"), part("Facts", "f"), part("Documents", "d")).alias("context"))


def session_summary(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts of turns by role and the length of what was said."""
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def save_sessions(turns: DataFrame, path: str, user_col: str = "user_id") -> None:
    turns.write.mode("append").partitionBy(user_col).json(path)


def load_sessions(spark, path: str, schema: str, user_id: str | None = None) -> DataFrame:
    found = spark.read.schema(schema).json(path)
    return found if user_id is None else found.where(F.col("user_id") == user_id)


def extract_facts(turns: DataFrame, ask: Callable[[str], str], n: int = 5, last: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, order, fact, category): at every n-th turn a provider is asked for
    facts in the last turns, as a JSON array; replies without one give none, a
    missing category is ``general``, an empty fact is no fact."""
    from siftstone.functions.text import json_array
    from siftstone.operators.tools import generate

    w = Window.partitionBy(key).orderBy(order)
    said = F.concat(F.upper(F.coalesce("role", F.lit(""))), F.lit(": "), F.coalesce("text", F.lit("")))
    held = turns.select(key, order, F.row_number().over(w).alias("number"), F.array_join(F.collect_list(said).over(w.rowsBetween(1 - last, 0)), "\n").alias("prompt"))
    replies = generate(held.where(F.col("number") % n == 0).drop("number"), ask)
    found = replies.select(key, order, F.explode(F.from_json(json_array(F.col("answer")), "array<struct<fact:string,category:string>>")).alias("x"))
    return found.where("x.fact <> ''").select(key, order, "x.fact", F.coalesce("x.category", F.lit("general")).alias("category"))
