"""Connected components of an edge table by alternating stars.

Large-star links every larger neighbour of a node to the node's least
neighbour, small-star every smaller one; after O(log^2 n) rounds each node is
linked to the least node of its component.  All rounds are joins and least
values by key: a node with many edges is combined before the shuffle, and both
join sides are plain tables, so that skewed keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b, longs) but
    the roots themselves; root is the component's least node."""
    now = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    at = store.made
    while _tangled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = store.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = store.keep(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        for k in range(at, store.made):
            store.drop(k)
        at = store.made
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """``roots`` (node, root) with more links (a, b): only the roots that these
    join are gone over again."""
    names = {c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"}
    edges = links.join(names["a"], "a", "left").join(names["b"], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    fresh = components(edges, store)
    moved = roots.join(fresh.select(F.col("node").alias("root"), F.col("root").alias("better")), "root", "left").select("node", F.coalesce("better", "root").alias("root"))
    return store.keep(moved.unionByName(fresh))


def _tangled(edges: DataFrame) -> int:
    """How many nodes have two smaller neighbours, or one and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count()
