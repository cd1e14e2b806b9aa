"""Document trees: sections, paragraphs, references, retrieval with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions.lineage import kept

MIN_PARAGRAPH = 50


def line_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Nodes (id, parent_id, document_id, level, position, content): documents,
    their lines, and the sentences of these."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    root = F.concat(F.lit("d"), F.col(id_col).cast("string"))
    docs = docs.select(F.col(id_col).alias("document_id"), root.alias("root"), text.alias("t"))
    top = docs.select(F.col("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), "document_id", F.lit(0).alias("level"), F.lit(0).alias("position"), F.substring("t", 1, 40).alias("content"))
    lines = docs.select("document_id", "root", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    line_id = F.concat("root", F.lit(".s"), F.col("n").cast("string"))
    sections = lines.select(line_id.alias("id"), F.col("root").alias("parent_id"), "document_id", F.lit(1).alias("level"), F.col("n").alias("position"), F.col("line").alias("content"))
    parts = sections.select(F.col("id").alias("parent_id"), "document_id", F.posexplode(F.split("content", r"\. ")).alias("position", "content"))
    leaves = parts.select(F.concat("parent_id", F.lit(".p"), F.col("position").cast("string")).alias("id"), "parent_id", "document_id", F.lit(2).alias("level"), "position", "content")
    return top.unionByName(sections).unionByName(leaves)


def markdown_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_PARAGRAPH) -> DataFrame:
    """Sections by ``#`` headings or numbered titles, paragraphs of at least
    ``least`` characters.  Nodes (id, parent_id, document_id, node_type, level,
    position, title, section_number, content)."""
    lines = docs.select(F.col(id_col).alias("document_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n", "line"))
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    number = F.regexp_extract("line", r"^(?:#{1,6}\s+)?(\d+(?:\.\d+)*)\.?\s+\S", 1)
    level = F.when(marks > 0, marks).when(number != "", F.size(F.split(number, r"\.")))
    lines = lines.withColumns({"head": level, "number": F.when(number != "", number), "title": F.trim(F.regexp_replace("line", r"^(#{1,6}\s+)?(\d+(\.\d+)*\.?\s+)?", ""))})
    w = Window.partitionBy("document_id").orderBy("n")
    # The nearest heading above of each lower level is a section's parent.
    for depth in range(1, 7):
        lines = lines.withColumn(f"at{depth}", F.last(F.when(F.col("head") <= depth, F.struct(F.col("head").alias("h"), F.col("n").alias("n"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = lambda n: F.concat(F.lit("d"), F.col("document_id").cast("string"), F.lit(".s"), n.cast("string"))
    root = F.concat(F.lit("d"), F.col("document_id").cast("string"))
    parent = F.lit(None).cast("int")
    for depth in range(6, 0, -1):
        parent = F.when((F.col("head") == depth + 1) & F.col(f"at{depth}").isNotNull(), F.col(f"at{depth}.n")).otherwise(parent)
    above = F.last(F.when(F.col("head").isNotNull(), F.col("n")), True).over(w)
    lines = lines.withColumns({"up": parent, "section": above})
    sections = lines.where("head is not null").select(own(F.col("n")).alias("id"), F.when(F.col("up").isNotNull(), own(F.col("up"))).otherwise(root).alias("parent_id"), "document_id", F.lit("section").alias("node_type"), F.col("head").alias("level"), F.col("n").alias("position"), "title", F.col("number").alias("section_number"), F.col("line").alias("content"))
    paragraphs = lines.where(F.col("head").isNull() & (F.length(F.trim("line")) >= least)).select(
        F.concat(root, F.lit(".p"), F.col("n").cast("string")).alias("id"), F.when(F.col("section").isNotNull(), own(F.col("section"))).otherwise(root).alias("parent_id"), "document_id", F.lit("paragraph").alias("node_type"),
        F.lit(7).alias("level"), F.col("n").alias("position"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("section_number"), F.trim("line").alias("content"))
    docs_ = docs.select(F.concat(F.lit("d"), F.col(id_col).cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col(id_col).alias("document_id"), F.lit("document").alias("node_type"), F.lit(0).alias("level"), F.lit(0).alias("position"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("section_number"), F.lit("").alias("content"))
    return docs_.unionByName(sections).unionByName(paragraphs)


def references(nodes: DataFrame) -> DataFrame:
    """(source_id, text, kind, target_id, resolved): "Section 3.2" and "[1]"
    in a node's content; section numbers resolve in the same document."""
    found = nodes.select(F.col("id").alias("source_id"), "document_id", F.explode(F.regexp_extract_all("content", F.lit(r"([Ss]ection \d+(?:\.\d+)*|\[\d+\])"), F.lit(1))).alias("text"))
    found = found.withColumns({"kind": F.when(F.col("text").startswith("["), "citation").otherwise("section"), "key": F.regexp_extract("text", r"(\d+(?:\.\d+)*)", 1)})
    targets = nodes.where("section_number is not null").groupBy("document_id", F.col("section_number").alias("key")).agg(F.min("id").alias("target_id")).withColumn("kind", F.lit("section"))
    return found.join(targets, ["document_id", "key", "kind"], "left").select("source_id", "document_id", "text", "kind", "target_id", F.col("target_id").isNotNull().alias("resolved"))


def parent_chain(nodes: DataFrame, hits: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, path): each hit's ancestors from the root down, all of them, or at
    most ``depth``.  A missing parent ends the chain, and so does one that is in
    it already.  A round is one join of what has not ended, which is written."""
    up = nodes.select(F.col("id").alias("node"), "parent_id")
    walk = kept(hits.select("id", F.col("id").alias("at"), F.array().cast("array<string>").alias("path")))
    done, rounds = None, 0
    while depth is None or rounds < depth:
        step = walk.join(up, walk["at"] == up["node"], "left")
        ends = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id")) | F.array_contains("path", F.col("parent_id"))
        step = kept(step.select("id", F.when(~ends, F.col("parent_id")).alias("at"), F.when(ends, F.col("path")).otherwise(F.concat(F.array("parent_id"), "path")).alias("path")))
        ended = step.where("at is null").select("id", "path")
        done, walk, rounds = ended if done is None else done.unionByName(ended), step.where("at is not null"), rounds + 1
        if walk.isEmpty():
            break
    rest = walk.select("id", "path")
    return rest if done is None else done.unionByName(rest)


def siblings(nodes: DataFrame, hits: DataFrame | None = None, most: int = 2) -> DataFrame:
    """(id, sibling_id, n): children of the same parent, the nearest by
    position (positions differ within a parent; of equally near ones the
    earlier).  Only ``most`` neighbours to either side are looked at, so a
    parent with many children costs no pairs of all of them."""
    w = Window.partitionBy("parent_id").orderBy("position", "id")
    near = []
    for k in range(1, most + 1):
        for move in (F.lag, F.lead):
            at = move("position", k).over(w)
            near.append(F.when(at.isNotNull(), F.struct(F.abs(at - F.col("position")).alias("gap"), at.alias("position"), move("id", k).over(w).alias("sibling_id"))))
    out = nodes.where("parent_id is not null").select("id", F.slice(F.array_sort(F.array_compact(F.array(*near))), 1, most).alias("near"))
    if hits is not None:
        out = out.join(hits.select("id"), "id", "left_semi")
    return out.select("id", F.posexplode("near").alias("n", "x")).select("id", "x.sibling_id", (F.col("n") + 1).alias("n"))


def drill_down(nodes: DataFrame, hits: DataFrame, n: int = 3, factor: float = 0.9) -> DataFrame:
    """Children of summary hits, the first n of each, at ``factor`` of the
    hit's score: (hit, id, score)."""
    w = Window.partitionBy("parent_id").orderBy("position", "id")
    first = nodes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    scored = hits.select(F.col("id").alias("parent_id"), "score")
    return first.join(scored, "parent_id").select(F.col("parent_id").alias("hit"), "id", F.round(F.col("score") * factor, 6).alias("score"))


def subtree(nodes: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, level, path) of all nodes below the roots, by child joins."""
    links = nodes.select("id", "parent_id", "position")
    frontier = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    out = frontier
    for d in range(1, depth + 1):
        step = links.join(frontier.select("root", F.col("id").alias("parent_id"), "path"), "parent_id")
        frontier = step.select("root", "id", F.lit(d).alias("depth"), F.concat("path", F.array("id")).alias("path"))
        out = out.unionByName(frontier)
    return out


def context(level: Column, title: Column, content: Column, limit: int = 500) -> Column:
    """One indented line of a hierarchical context."""
    return F.concat(F.repeat(F.lit("  "), level), F.when(title.isNotNull(), F.concat(title, F.lit(": "))).otherwise(""), F.substring(content, 1, limit))


def retrieve(hits: DataFrame, summaries: DataFrame, documents: int = 3, least: float = 0.5, k: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """Two stages: the best documents by summary score (at least ``least``),
    then the best nodes within them.  A caller's target documents narrow the
    first stage."""
    best = summaries.where(F.col("score") >= least)
    if targets is not None:
        best = best.join(targets.select("document_id"), "document_id", "left_semi")
    chosen = best.groupBy("document_id").agg(F.max("score").alias("s")).orderBy(F.col("s").desc(), "document_id").limit(documents)
    inside = hits.join(F.broadcast(chosen.select("document_id")), "document_id", "left_semi")  # a few rows
    return inside.orderBy(F.col("score").desc(), "id").limit(k)


def with_references(hits: DataFrame, refs: DataFrame, nodes: DataFrame, score: float = 0.5) -> DataFrame:
    """Hits and the nodes that they refer to, these at a fixed score."""
    far = refs.where("target_id is not null").join(hits.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    more = far.join(hits.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi").withColumn("score", F.lit(score))
    return hits.select("id", "score").unionByName(more)
