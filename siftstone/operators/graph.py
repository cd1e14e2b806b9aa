"""Bounded traversal of edge tables (source, target, type, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.lineage import kept


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *(c for c in edges.columns if c not in ("source", "target")))
    return edges.unionByName(back)


def neighbours(edges: DataFrame, vertices: DataFrame, nodes: DataFrame, kind: str | None = None, outgoing: bool = True) -> DataFrame:
    """Vertices next to ``nodes`` (column id); edges to unknown vertices are hidden."""
    if kind is not None:
        edges = edges.where(F.col("type") == kind)
    near, far = ("source", "target") if outgoing else ("target", "source")
    hits = edges.join(nodes.select(F.col("id").alias(near)), near).select(F.col(near).alias("node"), F.col(far).alias("id"), "type")
    return hits.join(vertices, "id")


def within(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all nodes within ``depth`` undirected steps of the
    start nodes, without these."""
    links = both_ways(edges).select("source", "target").distinct()
    seen = start.select("id", F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["id"] == links["source"]).select(F.col("target").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def shortest_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, kind: str | None = None, depth: int = 10) -> DataFrame:
    """(start, id, path) by breadth first search along directed edges, at most
    ``depth`` of them; of equally short ones the least; none when start is goal.
    The search ends when nothing new is reached."""
    if kind is not None:
        edges = edges.where(F.col("type") == kind)
    links = kept(edges.select("source", "target").distinct())
    frontier = start.select(F.col("id").alias("start"), "id", F.array("id").alias("path"))
    seen = found = frontier
    for _ in range(depth):
        step = frontier.join(links, frontier["id"] == links["source"]).select("start", F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        frontier = step.groupBy("start", "id").agg(F.min("path").alias("path")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = kept(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        found = seen
    return found.join(goal.select("id"), "id", "left_semi").where(F.size("path") > 1).select("start", "id", "path")


def chains(edges: DataFrame, start: DataFrame, depth: int = 5, kind: str | None = None) -> DataFrame:
    """All paths from the start nodes of up to ``depth`` edges without a node
    twice: (path, depth)."""
    if kind is not None:
        edges = edges.where(F.col("type") == kind)
    links = edges.select("source", "target").distinct()
    frontier = start.select("id", F.array("id").alias("path"))
    out = frontier
    for _ in range(depth):
        step = frontier.join(links, frontier["id"] == links["source"]).where(~F.array_contains("path", F.col("target")))
        frontier = step.select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        out = out.unionByName(frontier)
    return out.select("path", (F.size("path") - 1).alias("depth"))


def entity_search(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, score, path): over all seeds and ways, the best product of edge
    weights times half for each step, and the way that gives it (the least of
    equally good ones)."""
    links = both_ways(edges).select("source", "target", "weight")
    frontier = seeds.select("id", F.lit(1.0).alias("score"), F.array("id").alias("path"))
    out = None
    for _ in range(depth):
        step = frontier.join(links, frontier["id"] == links["source"]).where(~F.array_contains("path", F.col("target")))
        frontier = step.select(F.col("target").alias("id"), (F.col("score") * F.col("weight") * 0.5).alias("score"), F.concat("path", F.array("target")).alias("path"))
        out = frontier if out is None else out.unionByName(frontier)
    best = out.groupBy("id").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "path")).alias("x"))
    return best.select("id", (-F.col("x.s")).alias("score"), "x.path").join(seeds.select("id"), "id", "left_anti")


def named_in(questions: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """Entities whose name a question contains, anywhere and in any script, the
    first ``most`` by id; empty names are in no question.  A name is met by its
    first three characters (or all of a shorter one), which must stand somewhere
    in the question, so that no question meets every entity."""
    from pyspark.sql.window import Window

    lowered = questions.select("qid", F.lower("question").alias("q"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("q") - (n - 1)), lambda i: F.substring("q", i, F.lit(n)))
    every = F.concat(*(F.when(F.length("q") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)))
    asked = lowered.withColumn("first", F.explode(F.array_distinct(every)))
    named = entities.select("id", F.lower("name").alias("name")).where("name <> ''").withColumn("first", F.substring("name", 1, 3))
    hits = asked.join(named, "first").where(F.contains("q", F.col("name"))).select("qid", "id", "name").distinct()
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where(F.col("n") <= most)


def resolve_edges(calls: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """Edges from (source, name) to all symbols of that name."""
    return calls.join(symbols.select(F.col("id").alias("target"), "name"), "name").select("source", "target", F.lit(kind).alias("type"), F.lit(1.0).alias("weight"))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of vertices and edges by type."""
    v = vertices.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("part"), "type", "n")
    return v.unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("part"), "type", "n"))


def export(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON rows of both tables."""
    return vertices.select(F.to_json(F.struct("*")).alias("json")), edges.select(F.to_json(F.struct("*")).alias("json"))


def find(vertices: DataFrame, name: str | None = None, kind: str | None = None, **values: str) -> DataFrame:
    """Vertices of that name (in any case), type and column values."""
    found = vertices
    if name is not None:
        found = found.where(F.lower("name") == name.lower())
    if kind is not None:
        found = found.where(F.col("type") == kind)
    for column, value in values.items():
        found = found.where(F.col(column) == value)
    return found


def with_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """Vertices and new ones, which replace those of the same id."""
    return vertices.join(new.select("id"), "id", "left_anti").select(*vertices.columns).unionByName(new.select(*vertices.columns))


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and new ones, which replace those of the same ends and type."""
    ends = ["source", "target", "type"]
    return edges.join(new.select(*ends), ends, "left_anti").select(*edges.columns).unionByName(new.select(*edges.columns))


def export_network(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON rows as network drawers take them: nodes (id, label, group), edges
    (from, to, label, value)."""
    nodes = vertices.select(F.to_json(F.struct("id", F.col("name").alias("label"), F.col("type").alias("group"))).alias("json"))
    return nodes, edges.select(F.to_json(F.struct(F.col("source").alias("from"), F.col("target").alias("to"), F.col("type").alias("label"), F.col("weight").alias("value"))).alias("json"))
