"""Runs of several agents over the questions of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import speakers, tool_tables
from siftstone.plans.q_dialogue import ASKED, _any_phrase, _asked
from siftstone.plans.registry import query, table

#: What each agent says offline; the coordinator ends a run after the verifier, but
#: not where the question's length is a multiple of five.
_SAY = """CASE
    WHEN speaker = 'coordinator' AND last_speaker = 'verifier' AND length(question) % 5 > 0 THEN concat('answer ', length(question), ' TERMINATE')
    WHEN speaker = 'coordinator' THEN concat(CASE length(question) % 4 WHEN 0 THEN 'search: ' WHEN 1 THEN 'find the citation: ' WHEN 2 THEN 'verify: ' ELSE 'go on: ' END, step)
    WHEN speaker = 'retriever' THEN concat('found ', length(last_message), CASE WHEN length(question) % 3 = 0 THEN ', see section 2' ELSE '' END)
    ELSE concat(speaker, ' of ', length(last_message)) END"""


@query("agent_transcripts", f"""WITH RECURSIVE {ASKED},
runs AS (
  SELECT conv_id * 1000 + turn AS qid, question, 0 AS step, 'user_proxy' AS speaker, question AS message FROM asked
  UNION ALL
  SELECT qid, question, step, speaker, {_SAY} FROM (
    SELECT qid, question, step + 1 AS step, speaker AS last_speaker, message AS last_message,
      CASE speaker WHEN 'coordinator' THEN CASE WHEN {_any_phrase(("search", "retrieve"))} THEN 'retriever' WHEN {_any_phrase(("reference", "citation"))} THEN 'crossref'
          WHEN {_any_phrase(("summarize", "synthesize"))} THEN 'summarizer' WHEN {_any_phrase(("verify", "check"))} THEN 'verifier' ELSE 'retriever' END
        WHEN 'retriever' THEN CASE WHEN {_any_phrase(("reference", "see section"))} THEN 'crossref' ELSE 'summarizer' END
        WHEN 'crossref' THEN 'summarizer' WHEN 'summarizer' THEN 'verifier' ELSE 'coordinator' END AS speaker
    FROM (SELECT *, lower(message) AS q FROM runs WHERE step < 12 AND (step = 0 OR NOT contains(message, 'TERMINATE')))))
SELECT qid, max(step)::INT AS steps, CASE WHEN contains(arg_max(message, step), 'TERMINATE') THEN 'done' ELSE 'limit' END AS ended,
  trim(replace(arg_max(message, step) FILTER (speaker = 'coordinator'), 'TERMINATE', '')) AS answer, string_agg(speaker, '>' ORDER BY step) AS speakers
FROM runs GROUP BY qid""")
def agent_transcripts(spark, sf_dir):
    """Every question's run in a group, whole, with who spoke and how it ended."""
    questions = _asked(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "question")
    said = speakers.run(questions, lambda turn: turn.withColumn("message", F.expr(_SAY)))
    who = said.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "speaker"))), lambda x: x["speaker"]), ">").alias("speakers"))
    return speakers.outcomes(said).join(who, "qid")


@query("tools_from_sql", """
WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 5 AS m FROM orders)
SELECT o_orderkey, ['calculator', 'calculator', 'word_count', 'upper', 'weather'][m + 1] AS tool, m < 1 OR m IN (2, 3) AS success,
  CASE m WHEN 0 THEN (2 * (o_orderkey % 1000) + 1)::VARCHAR WHEN 2 THEN len(regexp_extract_all(o_orderpriority, '\\S+'))::VARCHAR WHEN 3 THEN upper(o_orderpriority) END AS output,
  CASE m WHEN 1 THEN 'ValueError: undefined' WHEN 4 THEN 'unknown tool: weather' END AS error
FROM o""")
def tools_from_sql(spark, sf_dir):
    """An answer of the catalog to every order, by SQL alone."""
    tool_tables.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_asked")
    return spark.sql("""
      SELECT o_orderkey, tool, success, output, error FROM run_tools(TABLE(
        SELECT o_orderkey, element_at(array('calculator', 'calculator', 'word_count', 'upper', 'weather'), int(o_orderkey % 5) + 1) AS tool,
          CASE o_orderkey % 5 WHEN 0 THEN concat('2 * ', o_orderkey % 1000, ' + 1') WHEN 1 THEN concat(o_orderkey, ' / (3 - 3)') ELSE o_orderpriority END AS argument
        FROM orders_asked), tool => 'tool', argument => 'argument')""")
