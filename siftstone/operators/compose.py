"""Whole retrieval flows, put together from the other operators.

Every flow is one plan from questions to context rows; a provider turns context
into an answer, and without one the context is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions import routing
from siftstone.functions.arrays import bind
from siftstone.functions.lineage import kept
from siftstone.functions.text import truncate
from siftstone.functions.times import freshness
from siftstone.operators import code, conversation, graph, hierarchy, retrieval, timeindex, tools


def hybrid(question: DataFrame, vectors: DataFrame, docs: DataFrame, terms: Sequence[str], edges: DataFrame | None = None, seeds: DataFrame | None = None, k: int = 10, depth: tuple[int, int, int] = (20, 20, 10), fuse: Callable[[DataFrame, int], DataFrame] = retrieval.rrf) -> DataFrame:
    """Dense, sparse and graph candidates of one question, fused to k ids."""
    lists = [retrieval.ranked(retrieval.knn(question, vectors, depth[0]).select("id", "score"), "vector"), retrieval.ranked(retrieval.bm25(docs, terms, depth[1]).select("id", "score"), "sparse")]
    if edges is not None and seeds is not None:
        lists.append(retrieval.ranked(retrieval.top_k(graph.entity_search(edges, seeds), depth[2]).select("id", "score"), "graph"))
    hits = lists[0]
    for more in lists[1:]:
        hits = hits.unionByName(more)
    return fuse(hits, k)


def context_of(hits: DataFrame, records: DataFrame, limit: int = 500) -> DataFrame:
    """(context): numbered sources in rank order; hits without a record drop."""
    rows = records.join(F.broadcast(hits.select("id", "rank")), "id")  # hits are a top-k
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), truncate(F.col("content"), limit))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def timed_context(items: DataFrame, as_of, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Time-weighted hits, and how fresh the newest of them is."""
    hits = timeindex.time_weighted(items, as_of, k)
    return hits, hits.agg(freshness(F.max("ts"), as_of).alias("note"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.array_sort(F.collect_set("source")).alias("sources"))


def code_search(units: DataFrame, name: str, phrase: str, k: int = 10, depth: int = 100) -> DataFrame:
    """Symbol and text matches of code units, the best ``depth`` of each fused by
    reciprocal ranks."""
    symbol = code.find_symbol(units, name, fuzzy=True).select("id", (1.0 / (1 + F.levenshtein(F.lower("name"), F.lit(name.lower())))).alias("score"))
    said = F.lower(F.concat_ws(" ", "name", "signature", "docstring"))
    text = units.where(F.contains(said, F.lit(phrase.lower()))).select("id", F.lit(1.0).alias("score"))
    best = lambda hits, source: retrieval.ranked(retrieval.top_k(hits, depth).select("id", "score"), source)
    return retrieval.rrf(best(symbol, "symbol").unionByName(best(text, "text")), k)


def code_context(units: DataFrame, edges: DataFrame, hits: DataFrame, related: int = 10, tests: int = 5) -> DataFrame:
    """Hits, the nearest related units and tests: (id, role)."""
    near = graph.within(edges, hits.select("id"), 2).join(units.select("id"), "id", "left_semi").orderBy("distance", "id").limit(related)
    tested = edges.where("type = 'tests'").join(hits.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct().orderBy("id").limit(tests)
    roles = [hits.select("id", F.lit(0).alias("o"), F.lit("hit").alias("role")), near.select("id", F.lit(1).alias("o"), F.lit("related").alias("role")), tested.select("id", F.lit(2).alias("o"), F.lit("test").alias("role"))]
    both = roles[0].unionByName(roles[1]).unionByName(roles[2])
    return both.groupBy("id").agg(F.min_by("role", "o").alias("role"))


def trace_flow(units: DataFrame, edges: DataFrame, start: str, goal: str) -> DataFrame:
    """Call paths from units named ``start`` to units named ``goal``, a row a
    step: (start, id, step, unit)."""
    paths = graph.shortest_paths(edges, code.find_symbol(units, start).select("id"), code.find_symbol(units, goal).select("id"), "calls")
    return paths.select("start", "id", F.posexplode("path").alias("step", "unit"))


def adaptive(question: str, nodes: DataFrame, hits: DataFrame, summaries: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    """Hierarchical retrieval by kind of question: referred nodes join the hits
    of cross-reference questions, children stand for the documents of broad
    ones, and others take the two stages."""
    spark = nodes.sparkSession
    kind = spark.range(1).select(routing.query_class(F.lit(question)).alias("k")).first().k
    best = hierarchy.retrieve(hits, summaries, k=k)
    if kind == "cross-reference":
        return hierarchy.with_references(best.select("id", "score"), refs, nodes)
    if kind == "broad":
        roots = summaries.orderBy(F.col("score").desc(), "document_id").limit(k)
        tops = nodes.where("parent_id is null").join(F.broadcast(roots), "document_id").select("id", "score")
        return hierarchy.drill_down(nodes, tops).select("id", "score")
    return best.select("id", "score")


def agentic(questions: DataFrame, registry: tools.Registry, knowledge: DataFrame, as_of, routes: Sequence[tuple] = routing.ROUTES) -> DataFrame:
    """(qid, route, tool, result): each question by its route; calculations and
    dates are tools, all else counts the documents that hold one of its words (or
    one of those of other such questions with its qid).  Every question gives one row."""
    routed = questions.withColumn("r", bind(F.col("question"), lambda q: routing.route(q, routes=routes))).select("qid", "question", F.coalesce("r.route", F.lit("direct")).alias("route"), F.col("r.tool").alias("tool"))
    asked = routed.withColumn("argument", routing.tool_argument(F.col("tool"), F.col("question")))
    told = lambda rows, result: rows.select("qid", "route", "tool", result.alias("result"))
    sums = told(asked.where("tool = 'calculator'").withColumn("x", registry.execute("calculator", F.col("argument"))), F.coalesce("x.output", F.concat(F.lit("error: "), "x.error")))
    dates = told(asked.where("tool = 'datetime'").withColumn("x", registry.execute("datetime", as_of)), F.col("x.output"))
    others = asked.where("tool is null or tool not in ('calculator', 'datetime')")
    words = others.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("([a-z0-9]{4,})"), F.lit(1)))).alias("w"))
    held = knowledge.select(F.col("id").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9]{4,})"), F.lit(1)))).alias("w"))
    found = held.join(words, "w").groupBy("qid").agg(F.concat(F.countDistinct("doc").cast("string"), F.lit(" documents")).alias("found"))
    return sums.unionByName(dates).unionByName(told(others.join(found, "qid", "left"), F.col("found")))


def turns_with_context(turns: DataFrame, n: int = 6) -> DataFrame:
    """User turns with history, rewriting need and prompt of a chat."""
    held = conversation.history(turns, n).where("role = 'user'")
    return held.withColumns({"rewrite": routing.needs_rewriting(F.col("text")), "prompt": F.concat_ws("\n\n", F.nullif("history", F.lit("")), F.concat(F.lit("user: "), "text"))})


def search_pages(pages: DataFrame, terms: Sequence[str], k: int = 5) -> DataFrame:
    """Stands in for a web search: BM25 over pages with tags stripped."""
    from siftstone.functions.text import strip_tags

    texts = pages.select(F.col("page_id").alias("doc_id"), strip_tags(F.col("html")).alias("text"))
    return pages.select(F.col("page_id").alias("id"), "url").join(F.broadcast(retrieval.bm25(texts, terms, k)), "id")


def retrieve_by_words(questions: DataFrame, knowledge: DataFrame, k: int = 3) -> DataFrame:
    """(qid, id, score, rank): records by how many of a question's words of four
    letters or more they hold, ties by id.  Words are joined by key."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{4,})"), F.lit(1)))).alias("w")
    hits = questions.select("qid", words("question")).join(knowledge.select("id", words("content")), "w").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("score"))
    return retrieval.top_k(hits, k, "score", "id", "qid")


def converse(turns: DataFrame, knowledge: DataFrame, ask: Callable[[str], str], k: int = 3, held: int = 6) -> DataFrame:
    """Every user turn of a chat from rewriting to answer: (conv_id, turn,
    question, rewritten, cited, answer).

    A question that refers back is rewritten with what the turns before cited
    (for their questions as they stood), then ``k`` records are retrieved and
    cited in rank order, and a provider answers from records, history and question.
    ``cited`` is the memory that later turns refer to."""
    asked = conversation.history(turns, held).where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), "history")
    asked = asked.withColumn("qid", F.struct("conv_id", "turn"))
    cited = lambda q: retrieve_by_words(q, knowledge, k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("cited"))
    first = asked.join(cited(asked.select("qid", "question")), "qid", "left").withColumn("best", F.concat(F.lit("source "), F.get("cited", F.lit(0)).cast("string")))
    before = conversation.recent(first, "best", 5, "cites").drop("cited", "best")
    plain = F.array().cast("array<string>")
    ready = before.withColumn("rewritten", F.when(routing.needs_rewriting(F.col("question")), routing.rewrite(F.col("question"), F.col("cites"), plain)))
    ready = ready.withColumn("query", F.coalesce("rewritten", "question")).drop("cites")
    found = ready.join(cited(ready.select("qid", F.col("query").alias("question"))), "qid", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>")))
    sources = F.array_join(F.transform("cited", lambda x: F.concat(F.lit("source "), x.cast("string"))), ", ")
    prompt = F.concat_ws("\n\n", F.nullif("history", F.lit("")), F.nullif(sources, F.lit("")), F.concat(F.lit("user: "), "query"))
    done = tools.generate(found.select("conv_id", "turn", "question", "rewritten", "cited", prompt.alias("prompt")), ask)
    return done.drop("prompt")


def hierarchical(nodes: DataFrame, hits: DataFrame, summaries: DataFrame, refs: DataFrame, k: int = 5, most: int = 3, targets: DataFrame | None = None) -> DataFrame:
    """Hierarchical retrieval in one flow: documents by summary, nodes within
    them, and beside every hit its ancestors, siblings, up to ``most`` referred
    nodes, its citation (by the deepest section above it) and its context."""
    best = hierarchy.retrieve(hits, summaries, k=k, targets=targets).select("id", "document_id", "score")
    best = kept(retrieval.top_k(best, k))
    chain = hierarchy.parent_chain(nodes, best).select("id", F.posexplode_outer("path").alias("depth", "above"))
    titles = nodes.select(F.col("id").alias("above"), "node_type", "level", "title")
    line = hierarchy.context(F.col("level"), F.col("title"), F.lit(""))
    up = chain.join(titles, "above", "left").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "above"))), lambda x: x["above"]).alias("parents"),
        F.max_by("title", F.when(F.col("node_type") == "section", F.col("depth"))).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("depth", line.alias("line"))))), lambda x: x["line"]), "\n").alias("above_lines"))
    beside = hierarchy.siblings(nodes, best).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sibling_id"))), lambda x: x["sibling_id"]).alias("siblings"))
    far = refs.where("target_id is not null").select(F.col("source_id").alias("id"), F.col("target_id")).distinct().join(best.select("id"), "id", "left_semi")
    far = far.join(nodes.select(F.col("id").alias("target_id"), "node_type", "title", "content"), "target_id").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("target_id", F.concat(F.lit("- ["), "node_type", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), truncate(F.col("content"), 200)).alias("line")))), 1, most).alias("far"))
    rows = best.join(up, "id", "left").join(beside, "id", "left").join(far, "id", "left").join(nodes.select("id", "content"), "id")
    none = F.array().cast("array<string>")
    cite = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] document "), F.col("document_id").cast("string"), F.coalesce(F.concat(F.lit(" > "), "section"), F.lit("")))
    related = F.transform("far", lambda x: x["line"])
    text = F.concat_ws("\n", F.nullif("above_lines", F.lit("")), F.col("content"), F.when(F.size("far") > 0, F.concat(F.lit("Related:\n"), F.array_join(related, "\n"))))
    return rows.select("rank", "id", "score", F.coalesce("parents", none).alias("parents"), F.coalesce("siblings", none).alias("siblings"), F.coalesce(F.transform("far", lambda x: x["target_id"]), none).alias("referred"), cite.alias("citation"), text.alias("context"))
