"""Hierarchy, conversation, routing, chunks, code and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siftstone.functions import calculator, routing, text, times
from siftstone.functions.lineage import kept
from siftstone.operators import chunking, code, conversation, hierarchy, learned, research, tools
from siftstone.plans.q_corpus import AS_OF, _as_of
from siftstone.plans.q_retrieval import _hits
from siftstone.operators.retrieval import fusion_features
from siftstone.plans.registry import query, table
from siftstone.sources import streams
from siftstone.sources import tables as table_sources
from siftstone.streaming import pipelines

TREE = r"""
tree AS (
  SELECT 'd' || doc_id AS id, NULL::VARCHAR AS parent_id, doc_id AS document_id, 0 AS level, 0 AS position FROM documents),
lines AS (
  SELECT doc_id AS document_id, 'd' || doc_id || '.s' || (i - 1) AS id, 'd' || doc_id AS parent_id, i - 1 AS position, l[i] AS content
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l) , (SELECT unnest(range(1, len(l) + 1)) AS i)),
leaves AS (
  SELECT document_id, parent_id, parent_id || '.p' || (i - 1) AS id, i - 1 AS position
  FROM (SELECT document_id, id AS parent_id, string_split(content, '. ') AS p FROM lines), (SELECT unnest(range(1, len(p) + 1)) AS i)),
nodes AS (
  SELECT id, parent_id, document_id, level, position FROM tree UNION ALL
  SELECT id, parent_id, document_id, 1, position FROM lines UNION ALL
  SELECT id, parent_id, document_id, 2, position FROM leaves)""".replace("FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l)", "FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")


def _nodes(spark, sf_dir):
    return hierarchy.line_tree(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("section_tree", f"WITH {TREE} SELECT document_id, level, count(*) AS n, max(position) AS last FROM nodes GROUP BY document_id, level")
def section_tree(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("document_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


@query("parent_chain", f"""WITH {TREE}
SELECT n.id, p.parent_id || '>' || n.parent_id AS path FROM nodes n JOIN nodes p ON p.id = n.parent_id WHERE n.level = 2""")
def parent_chain(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    chains = hierarchy.parent_chain(nodes, nodes.where("level = 2").select("id"))
    return chains.select("id", F.array_join("path", ">").alias("path"))


@query("siblings", f"""WITH {TREE},
p AS (SELECT a.id, b.id AS sibling_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.position - b.position), b.position, b.id)::INT AS n
  FROM nodes a JOIN nodes b ON a.parent_id = b.parent_id AND a.id <> b.id AND abs(a.position - b.position) <= 2)
SELECT id, sibling_id, n FROM p WHERE n <= 2""")
def siblings(spark, sf_dir):
    return hierarchy.siblings(_nodes(spark, sf_dir))


@query("drill_down", f"""WITH {TREE}, h AS (SELECT 'd' || doc_id AS id, n_chars / 37000.0::DOUBLE AS score FROM documents)
SELECT h.id AS hit, n.id, round(h.score * 0.9::DOUBLE, 6) AS score FROM h JOIN (
  SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY position, id) AS k FROM nodes) n ON n.parent_id = h.id WHERE k <= 3""")
def drill_down(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), (F.col("n_chars") / 37000.0).alias("score"))
    return hierarchy.drill_down(_nodes(spark, sf_dir), hits)


@query("last_n_turns", """
SELECT conv_id, turn, role, recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency <= 3""")
def last_n_turns(spark, sf_dir):
    return conversation.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "recency")


@query("turn_history", """
SELECT conv_id, turn, md5(coalesce(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS history FROM conversations""")
def turn_history(spark, sf_dir):
    out = conversation.history(table(spark, sf_dir, "conversations"), 2)
    return out.select("conv_id", "turn", F.md5("history").alias("history"))


@query("turn_trigger", """
SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r % 3 = 0""")
def turn_trigger(spark, sf_dir):
    return conversation.every(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn")


@query("session_summary", """
SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def session_summary(spark, sf_dir):
    return conversation.session_summary(table(spark, sf_dir, "conversations"))


#: Questions that the rules are tried on, by conversation and turn.
QUESTIONS = (
    "Calculate 12 + 30 for", "What time is it in", "Write some code for", "Latest news about", "According to the report on", "Tell me more about", "What about the second one in",
    "Compare them with", "Explain the main idea of", "How do I find a document on", "Overview of items related to", "It?", "What is 5 * 7 and", "the last entry of", "Why does it fail in",
)
_ASK_SQL = "[" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][CAST((conv_id * 7 + turn) % {len(QUESTIONS)} AS INT) + 1]"
ASKED = f"asked AS (SELECT conv_id, turn, CASE WHEN {_ASK_SQL} = 'It?' THEN 'It?' ELSE {_ASK_SQL} || ' topic ' || conv_id END AS question FROM conversations WHERE role = 'user')"


def _asked(spark, sf_dir):
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    return turns.withColumn("question", F.when(q == "It?", q).otherwise(F.concat(q, F.lit(" topic "), F.col("conv_id").cast("string"))))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_pattern(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(q, {_lit(p)})" for p in patterns) + ")"


def _any_phrase(phrases) -> str:
    return "(" + " OR ".join(f"contains(q, {_lit(p)})" for p in phrases) + ")"


_ROUTE = "CASE " + " ".join(f"WHEN {_any_pattern(p)} THEN {_lit(n)}" for n, _, _, p in routing.ROUTES) + " END"
_TOOL = "CASE " + " ".join(f"WHEN {_any_pattern(p)} THEN {_lit(t) if t else 'NULL'}" for _, t, _, p in routing.ROUTES) + " END"


@query("route_patterns", f"WITH {ASKED} SELECT conv_id, turn, {_ROUTE} AS route, {_TOOL} AS tool FROM (SELECT *, lower(question) AS q FROM asked)")
def route_patterns(spark, sf_dir):
    r = routing.route(F.col("question"))
    return _asked(spark, sf_dir).select("conv_id", "turn", r["route"].alias("route"), r["tool"].alias("tool"))


_HITS = {k: " + ".join(f"contains(q, {_lit(p)})::INT" for p in v) for k, v in routing.INTENTS.items()}


@query("intent", f"""WITH {ASKED}, h AS (SELECT conv_id, turn, {", ".join(f"{v} AS {k}" for k, v in _HITS.items())} FROM (SELECT *, lower(question) AS q FROM asked)),
m AS (SELECT *, greatest({", ".join(_HITS)}) AS best FROM h)
SELECT conv_id, turn, CASE WHEN best = 0 THEN 'unknown' {" ".join(f"WHEN {k} = best THEN '{k}'" for k in _HITS)} END AS intent, least(best / 2.0::DOUBLE, 1.0) AS confidence FROM m""")
def intent(spark, sf_dir):
    i = routing.intent(F.col("question"))
    return _asked(spark, sf_dir).select("conv_id", "turn", i["intent"].alias("intent"), i["confidence"].alias("confidence"))


@query("query_class", f"""WITH {ASKED} SELECT conv_id, turn, CASE WHEN {_any_phrase(routing.CROSS_REFERENCE)} THEN 'cross-reference' WHEN {_any_phrase(routing.BROAD)} THEN 'broad' ELSE 'specific' END AS class
FROM (SELECT *, lower(question) AS q FROM asked)""")
def query_class(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", routing.query_class(F.col("question")).alias("class"))


_WORDS = r"list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')"


@query("needs_rewrite", f"""WITH {ASKED} SELECT conv_id, turn, list_has_any({_WORDS}, [{", ".join(map(_lit, routing.PRONOUNS))}]) OR {_any_phrase(routing.REFERRING)} OR (len({_WORDS}) <= 3 AND contains(question, '?')) AS rewrite
FROM (SELECT *, lower(question) AS q FROM asked)""")
def needs_rewrite(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", routing.needs_rewriting(F.col("question")).alias("rewrite"))


@query("rule_rewrite", f"""WITH {ASKED},
held AS (SELECT conv_id, turn, list('source ' || turn ORDER BY turn) FILTER (role = 'assistant') OVER w AS cites, list(role || turn ORDER BY turn) OVER w AS ents
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT a.*, lower(question) AS q, coalesce(cites, [])[-5:] AS c, coalesce(ents, [])[-5:] AS e FROM asked a JOIN held h USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN {_any_phrase(routing.MORE)} THEN 'Tell me more about ' || e[-1]
  {" ".join(f"WHEN contains(q, {_lit(p)}) AND coalesce(c[{i + 1 if i >= 0 else -1}], e[{i + 1 if i >= 0 else -1}]) IS NOT NULL THEN replace(q, {_lit(p)}, '''' || coalesce(c[{i + 1 if i >= 0 else -1}], e[{i + 1 if i >= 0 else -1}]) || '''')" for p, i in routing.ORDINALS)}
  END AS rewritten FROM j""")
def rule_rewrite(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    cited = F.when(F.col("role") == "assistant", F.concat(F.lit("source "), F.col("turn").cast("string")))
    held = conversation.recent(turns.withColumn("cite", cited).withColumn("ent", F.concat("role", F.col("turn").cast("string"))), "cite", 5, "cites")
    held = conversation.recent(held, "ent", 5, "ents").select("conv_id", "turn", "cites", "ents")
    return _asked(spark, sf_dir).join(held, ["conv_id", "turn"]).select("conv_id", "turn", routing.rewrite(F.col("question"), F.col("cites"), F.col("ents")).alias("rewritten"))


@query("tool_args", rf"""WITH {ASKED}, r AS (SELECT *, {_TOOL} AS tool FROM (SELECT *, lower(question) AS q FROM asked))
SELECT conv_id, turn, tool, CASE WHEN tool = 'calculator' THEN CASE WHEN len(regexp_extract_all(question, '[0-9.+*/()^-]+')) > 0 THEN array_to_string(regexp_extract_all(question, '[0-9.+*/()^-]+'), ' ') ELSE question END
  WHEN tool = 'datetime' THEN CASE WHEN contains(q, 'time') THEN 'time' WHEN contains(q, 'date') THEN 'date' WHEN contains(q, 'day') THEN 'weekday' ELSE 'now' END
  ELSE question END AS argument FROM r WHERE tool IS NOT NULL""")
def tool_args(spark, sf_dir):
    asked = _asked(spark, sf_dir).withColumn("tool", routing.route(F.col("question"))["tool"]).where("tool is not null")
    return asked.select("conv_id", "turn", "tool", routing.tool_argument(F.col("tool"), F.col("question")).alias("argument"))


@query("next_speaker", f"""WITH {ASKED}, s AS (SELECT conv_id, turn, ['user_proxy', 'coordinator', 'retriever', 'crossref', 'summarizer', 'verifier'][CAST(conv_id % 6 AS INT) + 1] AS last, lower(question || ' see section; verify') AS q FROM asked)
SELECT conv_id, turn, last, CASE last WHEN 'coordinator' THEN CASE WHEN {_any_phrase(("search", "retrieve"))} THEN 'retriever' WHEN {_any_phrase(("reference", "citation"))} THEN 'crossref'
    WHEN {_any_phrase(("summarize", "synthesize"))} THEN 'summarizer' WHEN {_any_phrase(("verify", "check"))} THEN 'verifier' ELSE 'retriever' END
  WHEN 'retriever' THEN CASE WHEN {_any_phrase(("reference", "see section"))} THEN 'crossref' ELSE 'summarizer' END
  WHEN 'crossref' THEN 'summarizer' WHEN 'summarizer' THEN 'verifier' ELSE 'coordinator' END AS next FROM s""")
def next_speaker(spark, sf_dir):
    who = F.element_at(F.array(*map(F.lit, ("user_proxy", "coordinator", "retriever", "crossref", "summarizer", "verifier"))), (F.col("conv_id") % 6 + 1).cast("int"))
    s = _asked(spark, sf_dir).withColumn("last", who).withColumn("m", F.concat("question", F.lit(" see section; verify")))
    return s.select("conv_id", "turn", "last", routing.next_speaker(F.col("last"), F.col("m")).alias("next"))


@query("calculator", "SELECT o_orderkey, round(pow(o_orderkey % 7, 2) + sqrt(16) * 3 - (o_orderkey % 5) / 2.0 + 17 % 5, 6) AS value FROM orders")
def calc(spark, sf_dir):
    """A parsed expression with two columns put in as numbers of a table."""
    fixed = calculator.to_column("sqrt(16) * 3 + 17 % 5")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.pow(key % 7, F.lit(2)) - (key % 5) / 2 + fixed, 6).alias("value"))


@query("clock", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, dayname(ts) AS weekday, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS stamp FROM events")
def clock(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", *(times.clock(k, ts).alias(n) for k, n in (("date", "date"), ("time", "time"), ("weekday", "weekday"), ("timestamp", "stamp"))))


@query("log_levels", """
SELECT event_id, CASE WHEN contains(u, 'DEBUG') THEN 'DEBUG' WHEN contains(u, 'INFO') THEN 'INFO' WHEN contains(u, 'WARNING') THEN 'WARNING' WHEN contains(u, 'ERROR') THEN 'ERROR' WHEN contains(u, 'CRITICAL') THEN 'CRITICAL' ELSE 'INFO' END AS level
FROM (SELECT event_id, upper(event_type || CASE WHEN event_id % 3 = 0 THEN ' warning' ELSE '' END) AS u FROM events)""")
def log_levels(spark, sf_dir):
    line = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " warning").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", streams.log_level(line).alias("level"))


@query("webhook_ingest", f"""
SELECT 'e' || event_id AS id, event_type AS content, 'generic' AS content_type, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '{AS_OF}' ELSE ts END AS ts, least(greatest(event_id % 8, 1), 5)::INT AS priority
FROM events WHERE event_id % 5 <> 0""")
def webhook_ingest(spark, sf_dir):
    """Payloads with a missing content or a broken time among them."""
    ts = F.when(F.col("event_id") % 4 == 0, "no time").otherwise(F.col("ts").cast("string"))
    body = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("content"), ts.alias("timestamp"), (F.col("event_id") % 8).cast("int").alias("priority")))
    items = streams.webhook_items(table(spark, sf_dir, "events").select(body.alias("value")), _as_of())
    return items.select("id", "content", "content_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "priority")


@query("protocol_lines", """
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'poor' WHEN item_id % 3 = 1 THEN 'good' ELSE 'good' END AS quality, CASE WHEN item_id % 2 = 0 THEN round(item_id / 100.0::DOUBLE, 2) ELSE 0.7 END AS coverage, item_id % 4 = 0 AS web FROM benchmark""")
def protocol_lines(spark, sf_dir):
    """Model replies of KEY: value lines, some with unknown values."""
    i = F.col("item_id")
    reply = F.concat(F.lit("Some words.\nQUALITY: "), F.when(i % 3 == 0, "POOR").when(i % 3 == 1, "Good").otherwise("dreadful"), F.lit("\n COVERAGE_SCORE: "), F.when(i % 2 == 0, (i / 100).cast("string")).otherwise("n/a"), F.lit("\nNEEDS_WEB_SEARCH: "), F.when(i % 4 == 0, "True").otherwise("false"))
    r = table(spark, sf_dir, "benchmark").select("item_id", reply.alias("r"))
    return r.select("item_id", text.one_of(text.protocol_value(F.col("r"), "QUALITY"), ("excellent", "good", "partial", "poor", "irrelevant"), "good").alias("quality"),
                    F.round(F.coalesce(F.expr("try_cast(regexp_extract(r, 'COVERAGE_SCORE: *([^\\n]*)', 1) as double)"), F.lit(0.7)), 2).alias("coverage"), F.contains(F.lower(text.protocol_value(F.col("r"), "NEEDS_WEB_SEARCH")), F.lit("true")).alias("web"))


@query("rescue_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def rescue_json(spark, sf_dir):
    reply = F.concat(F.lit("Sure, here it is:\n"), F.col("props"), F.lit("\nAnything else?"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text.json_object(reply), "k bigint")["k"].alias("k"))


@query("rag_context", """
WITH t AS (SELECT source, doc_id, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
SELECT source, string_agg('[' || n || '] doc ' || doc_id || chr(10) || left(text, 300), chr(10) || chr(10) ORDER BY n) AS context FROM t WHERE n <= 3 GROUP BY source""")
def rag_context(spark, sf_dir):
    from siftstone.operators.retrieval import top_k

    top = top_k(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), "text"), 3, "score", "id", "source")
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] doc "), F.col("id").cast("string"), F.lit("\n"), text.truncate(F.col("text"), 300))
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


@query("citations", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY user_id, event_type),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, event_type) AS number FROM f)
SELECT e.user_id, e.event_id, e.event_type, n.number FROM events e JOIN n USING (user_id, event_type)""")
def citations(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return conversation.citations(hits, ["user_id"], "event_type", ["event_id"]).select("user_id", "event_id", "event_type", "number")


@query("preferences", """
SELECT user_id, event_type AS key, arg_max(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS value FROM events GROUP BY user_id, event_type""")
def preferences(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("at"))
    return conversation.preferences(log)


@query("event_windows", """
SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def event_windows(spark, sf_dir):
    out = pipelines.windowed_counts(pipelines.timed(table(spark, sf_dir, "events")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    out = pipelines.sessions(pipelines.timed(table(spark, sf_dir, "events")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_counts(spark, sf_dir):
    return pipelines.unseen(table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("strip_tags", """SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_md5 FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("text_md5"))


@query("html_text")
def html_text(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "pages"), lambda h: [table_sources.visible_text(h)], "page_id", "html").select(F.col("id").alias("page_id"), F.col("chunk").alias("text"))


@query("html_tables", """
SELECT o_orderkey::BIGINT AS id, t AS table_index, 0 AS row_idx, c AS col_idx, CASE WHEN t = 0 THEN ['key', 'who & what'][c + 1] ELSE 'only' END AS col,
  CASE WHEN t = 0 AND c = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN t = 0 THEN o_orderpriority ELSE 'status ' || o_orderstatus END AS value
FROM orders, (VALUES (0, 0), (0, 1), (1, 0)) AS v(t, c)""")
def html_tables(spark, sf_dir):
    """Two tables on a page for every order, one with a head section."""
    cell = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    page = cell("<html><body><p>Order</p><table><caption> of one </caption><thead><tr><th>key</th><th>who &amp; what</th></tr></thead><tr><td>", F.col("o_orderkey"), "</td><td> <b>", F.col("o_orderpriority"),
                "</b>\n</td></tr></table><div><table><tr><th>only</th></tr><tr><td>status <i>", F.col("o_orderstatus"), "</i></td></tr></table></div></body></html>")
    return table_sources.table_cells(table_sources.extract_tables(table(spark, sf_dir, "orders").select("o_orderkey", page.alias("html")), "o_orderkey", "html"))



@query("md_tables", """
SELECT o_orderkey::BIGINT AS id, 0 AS table_index, 0 AS row_idx, unnest([0, 1]) AS col_idx, unnest(['key', 'priority']) AS col, unnest([CAST(o_orderkey AS VARCHAR), o_orderpriority]) AS value FROM orders""")
def md_tables(spark, sf_dir):
    rows = F.concat_ws("\n", F.lit("Sales:"), F.lit("| key | priority |"), F.lit("|---|:-:|"), F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |")), F.lit("end"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", rows.alias("md"))
    return table_sources.table_cells(table_sources.extract_tables(docs, "o_orderkey", "md", table_sources.markdown_tables))


@query("chunk_chars")
def chunk_chars(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents"), chunking.by_chars)


@query("chunk_words", r"""WITH RECURSIVE
d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS MATERIALIZED (SELECT doc_id, i, word, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS stop FROM e),
-- a chunk from word i ends before the first later word that does not fit
jump AS MATERIALIZED (
  SELECT a.doc_id, a.i, greatest(coalesce(b.i, 0), a.i) + 1 AS next
  FROM (SELECT doc_id, i, stop - length(word) + 1000 AS fits FROM s) a ASOF LEFT JOIN s b ON a.doc_id = b.doc_id AND a.fits >= b.stop),
c AS (
  SELECT doc_id, 0 AS n, 1::BIGINT AS i FROM d WHERE len(w) > 0 UNION ALL
  SELECT c.doc_id, n + 1, next FROM c JOIN jump j ON j.doc_id = c.doc_id AND j.i = c.i WHERE next <= (SELECT len(w) FROM d WHERE d.doc_id = c.doc_id))
SELECT c.doc_id::BIGINT AS id, n::INT AS chunk_index, array_to_string(w[c.i : next - 1], ' ') AS chunk FROM c JOIN jump j ON j.doc_id = c.doc_id AND j.i = c.i JOIN d ON d.doc_id = c.doc_id""")
def chunk_words(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents"), chunking.by_words)


@query("chunk_paragraphs", r"""WITH RECURSIVE
d AS MATERIALIZED (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\S')) AS ps FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM d),
s AS (SELECT doc_id, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM e),
u AS MATERIALIZED (SELECT doc_id, ps, list_prepend(0, list(upto ORDER BY i)) AS upto FROM s JOIN d USING (doc_id) GROUP BY doc_id, ps),
r AS (
  SELECT doc_id, -1 AS n, 0::BIGINT AS start, '' AS chunk FROM u
  UNION ALL
  SELECT doc_id, n + 1, stop, array_to_string(list_concat(CASE WHEN lead = '' THEN [] ELSE [lead] END, ps[start + 1 : stop]), chr(10) || chr(10))
  FROM (SELECT *, greatest(len(list_filter(upto, lambda x: x <= upto[start + 1] + 1000 - length(lead))) - 1, start + 1) AS stop
    FROM (SELECT r.doc_id, n, start, ps, upto, CASE WHEN length(chunk) > 200 THEN right(chunk, 200) ELSE '' END AS lead FROM r JOIN u USING (doc_id) WHERE start < len(ps))))
SELECT doc_id AS id, n AS chunk_index, chunk FROM r WHERE n >= 0""")
def chunk_paragraphs(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents"), lambda t: chunking.by_paragraphs([p for p in t.split("\n") if p.strip()]))


@query("embed_hash")
def embed_hash(spark, sf_dir):
    return tools.embed(table(spark, sf_dir, "benchmark"), "item_id", "text")


#: A module for every customer; # stands for the customer's number.
SOURCE = '''import os
LIMIT = 10

class Base#:
    """A base."""
    def run(self, x: int = 1) -> int:
        return helper#(x) if x and x > 0 else 0

class Child#(Base#):
    @property
    def name(self):
        return [c for c in os.name if c]

async def fetch#(url, *args, **kw):
    for a in args:
        await a
    return helper#(url)

def helper#(v):
    return v

def test_helper#():
    assert helper#(1) == 1
'''
_PARSED = """
parsed(name, type, start_line, end_line, signature, docstring, parent_class, decorators, parameters, calls, bases, is_async, is_test, complexity) AS (VALUES
  ('LIMIT', 'constant', 2, 2, NULL, NULL, NULL, '', '', '', '', false, false, NULL),
  ('Base#', 'class', 4, 7, 'class Base#', 'A base.', NULL, '', '', 'helper#', '', false, false, NULL),
  ('run', 'method', 6, 7, 'def run(self, x: int = ...) -> int', NULL, 'Base#', '', 'self,x: int = ...', 'helper#', '', false, false, 2),
  ('Child#', 'class', 9, 12, 'class Child#(Base#)', NULL, NULL, '', '', '', 'Base#', false, false, NULL),
  ('name', 'property', 11, 12, 'def name(self)', NULL, 'Child#', 'property', 'self', '', '', false, false, 2),
  ('fetch#', 'async_function', 14, 17, 'async def fetch#(url, *args, **kw)', NULL, NULL, '', 'url,*args,**kw', 'helper#', '', true, false, 2),
  ('helper#', 'function', 19, 20, 'def helper#(v)', NULL, NULL, '', 'v', '', '', false, false, 1),
  ('test_helper#', 'function', 22, 23, 'def test_helper#()', NULL, NULL, '', '', 'helper#', '', false, true, 1))"""
_FILLED = lambda c: f"replace({c}, '#', c_custkey::VARCHAR) AS {c}"


def _units(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("app/m"), key, F.lit(".py")).alias("path"), F.replace(F.lit(SOURCE), F.lit("#"), key).alias("source"))
    broken = files.select(F.concat(F.lit("broken/"), "path").alias("path"), F.lit("def (:").alias("source"))
    return code.parse_units(files.unionByName(broken))


@query("ast_units", f"""WITH {_PARSED}
SELECT 'app/m' || c_custkey || '.py' AS path, replace('app/m#.py::' || coalesce(parent_class || '.', '') || name, '#', c_custkey::VARCHAR) AS id, {", ".join(map(_FILLED, ("name", "signature", "parent_class", "calls", "bases")))},
  type, start_line, end_line, docstring, decorators, parameters, is_async, false AS is_private, is_test, complexity::INT AS complexity FROM customer, parsed""")
def ast_units(spark, sf_dir):
    joined = {c: F.array_join(c, ",") for c in ("decorators", "parameters", "calls", "bases")}
    return _units(spark, sf_dir).withColumns(joined)


@query("code_graph", """
SELECT replace('app/m#.py::' || a, '#', c_custkey::VARCHAR) AS source, replace('app/m#.py::' || b, '#', c_custkey::VARCHAR) AS target, type, 1.0::DOUBLE AS weight FROM customer, (VALUES
  ('Base#.run', 'helper#', 'calls'), ('fetch#', 'helper#', 'calls'), ('test_helper#', 'helper#', 'calls'), ('Child#', 'Base#', 'extends'),
  ('Base#', 'Base#.run', 'contains'), ('Child#', 'Child#.name', 'contains'), ('test_helper#', 'helper#', 'tests')) AS v(a, b, type)""")
def code_graph(spark, sf_dir):
    return code.code_edges(kept(_units(spark, sf_dir)))


@query("learned_fusion")
def learned_fusion(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    features = fusion_features(hits)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return learned.fuse(learned.train(features, labels), features, hits, 10)


@query("tool_results", """
SELECT n_nationkey, true AS success, n_nationkey * n_nationkey + 4::DOUBLE AS output, false AS bad_success, NULL::VARCHAR AS bad_output, true AS told FROM nation""")
def tool_results(spark, sf_dir):
    registry = tools.standard()
    sums = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(" ^ 2 / (3 - n)")).alias("bad"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" ^ 2 + sqrt(16)")).alias("sum"))
    done = sums.select("n_nationkey", registry.execute("calculator", F.col("sum")).alias("ok"), registry.execute("calculator", F.col("bad")).alias("bad"))
    return done.select("n_nationkey", F.col("ok.success").alias("success"), F.col("ok.output").cast("double").alias("output"), F.col("bad.success").alias("bad_success"), F.col("bad.output").alias("bad_output"), F.col("bad.error").isNotNull().alias("told"))


@query("classify_json", """
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN octet_length(encode(text)) % 2 = 1 THEN 'chart' ELSE 'other' END AS kind, 'd' AS description, '' AS text FROM benchmark""")
def classify_json(spark, sf_dir):
    images = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return tools.describe_images(images, lambda b: '{"kind": "%s", "description": "d", "text": ""}' % ("chart" if len(b) % 2 else "unknown"))


@query("research_loop", """
WITH q AS (SELECT item_id, length(text) AS n, length(text) % 4 AS open FROM benchmark)
SELECT item_id::VARCHAR AS question, (n % 3)::INT AS findings, open::INT AS contradictions, CASE WHEN open > 0 THEN open * (open + 1) // 2 - CASE WHEN open > 3 THEN 1 ELSE 0 END ELSE 0 END::INT AS resolved,
  CASE WHEN open > 0 THEN open * (open - 1) // 2 ELSE 0 END::INT AS uncertain, (1 + open)::INT AS iterations FROM q""")
def research_loop(spark, sf_dir):
    """A stand-in model that leaves one item fewer open after every round."""

    def ask(prompt: str) -> str:
        kind, rest = prompt.split(": ", 1)
        if kind == "Research":
            n = len(rest.split("|", 1)[1])
            return "Here: " + json.dumps({"findings": [{"claim": "a"}] * (n % 3), "contradictions": [{"topic": str(i)} for i in range(n % 4)], "summary": "s"}) + " done."
        left = json.loads(rest)
        return json.dumps({"resolved_claims": [{"verified_fact": x["topic"]} for x in left], "still_uncertain": [{"topic": x["topic"]} for x in left[1:]]})

    asked = table(spark, sf_dir, "benchmark").select(F.concat_ws("|", F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).alias("question"))
    out = research.research_all(asked, ask)
    return out.select(F.substring_index("question", "|", 1).alias("question"), "findings", "contradictions", "resolved", "uncertain", "iterations")
