"""Duplicates, timed items, graphs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from siftstone.functions import times
from siftstone.functions.lineage import folder, kept
from siftstone.operators import dedup, graph, state, timeindex
from siftstone.operators.time_store import TimeStore
from siftstone.plans.registry import query, table
from siftstone.streaming import metrics, near

_AB = dedup.multipliers()
_LIMBS = "0::BIGINT"
for _i in range(4):
    _LIMBS = f"(({_LIMBS}) * 4294967296 + CAST('0x' || substr(d, {1 + 8 * _i}, 8) AS BIGINT)) % 2147483647"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]', '', 'g'), '[\\s\\p{Z}]+'), lambda x: x <> '')"


def _shingle_sql(name: str, source: str, key: str, n: int) -> str:
    words = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
{name}_w AS (SELECT {key} AS id, {_WORDS} AS w FROM {source}),
{name} AS (SELECT DISTINCT id, {words} AS shingle FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {name}_w WHERE len(w) >= {n}))"""


SIGNED = _shingle_sql("sh", "documents", "doc_id", 3) + f""",
hs AS (SELECT id, {_LIMBS} AS h FROM (SELECT id, md5(shingle) AS d FROM sh)),
ab AS (SELECT unnest(range(1, 129)) AS i, unnest([{", ".join(str(a) for a, _ in _AB)}]::BIGINT[]) AS a, unnest([{", ".join(str(b) for _, b in _AB)}]::BIGINT[]) AS b),
signed AS (SELECT id, list(m ORDER BY i) AS signature FROM (SELECT id, i, min((a * h + b) % 2147483647) AS m FROM hs, ab GROUP BY id, i) GROUP BY id),
classes AS (SELECT signature, min(id) AS class_id, count(*) AS n FROM signed GROUP BY signature),
bands AS (SELECT class_id, b, array_to_string(signature[b * 8 + 1 : b * 8 + 8], ',') AS bucket FROM classes, (SELECT unnest(range(0, 16)) AS b)),
cand AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM bands x JOIN bands y ON x.b = y.b AND x.bucket = y.bucket AND x.class_id < y.class_id),
pairs AS (
  SELECT c.a, c.b, round(list_sum(list_transform(range(1, 129), lambda i: (sa.signature[i] = sb.signature[i])::INT)) / 128.0::DOUBLE, 6) AS similarity
  FROM cand c JOIN classes sa ON sa.class_id = c.a JOIN classes sb ON sb.class_id = c.b)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("minhash_signature", f"WITH {SIGNED} SELECT id, array_to_string(signature, ',') AS signature FROM signed")
def minhash_signature(spark, sf_dir):
    return dedup.signatures(_docs(spark, sf_dir)).select("id", F.array_join("signature", ",").alias("signature"))


@query("lsh_candidates", f"WITH {SIGNED} SELECT a, b FROM cand")
def lsh_candidates(spark, sf_dir):
    return dedup.candidates(kept(dedup.classes(dedup.signatures(_docs(spark, sf_dir)))))


@query("near_dup_pairs", f"WITH {SIGNED} SELECT a, b, similarity FROM pairs WHERE similarity >= 0.8")
def near_dup_pairs(spark, sf_dir):
    """Links between classes of equal signatures."""
    return dedup.near_pairs(kept(dedup.classes(dedup.signatures(_docs(spark, sf_dir)))))


@query("near_dup_members", f"WITH {SIGNED} SELECT s.id, c.class_id, c.n FROM signed s JOIN classes c USING (signature)")
def near_dup_members(spark, sf_dir):
    signed = kept(dedup.signatures(_docs(spark, sf_dir)))
    return signed.join(dedup.classes(signed), "signature").select("id", "class_id", "n")


@query("dedup_first_match", f"""WITH {SIGNED},
ex AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents WHERE text IS NOT NULL),
best AS (SELECT b AS class_id, arg_min(a, (-similarity, a)) AS a, max(similarity) AS s FROM pairs WHERE similarity >= 0.8 GROUP BY b),
near AS (SELECT s.id, CASE WHEN c.class_id < s.id THEN c.class_id ELSE best.a END AS near, CASE WHEN c.class_id < s.id THEN 1.0 ELSE best.s END AS s
  FROM signed s JOIN classes c USING (signature) LEFT JOIN best ON best.class_id = c.class_id)
SELECT * FROM (
  SELECT ex.id, CASE WHEN first < ex.id THEN first ELSE near END AS duplicate_of, CASE WHEN first < ex.id THEN 1.0::DOUBLE ELSE s::DOUBLE END AS similarity
  FROM ex LEFT JOIN near ON near.id = ex.id) WHERE duplicate_of IS NOT NULL""")
def dedup_first_match(spark, sf_dir):
    return dedup.first_match(_docs(spark, sf_dir))


@query("near_dup_within_retention", f"""WITH {SIGNED},
own AS (SELECT id, b, array_to_string(signature[b * 8 + 1 : b * 8 + 8], ',') AS bucket FROM signed, (SELECT unnest(range(0, 16)) AS b)),
near AS (SELECT DISTINCT x.id AS id, y.id AS o FROM own x JOIN own y ON x.b = y.b AND x.bucket = y.bucket AND y.id < x.id AND x.id - y.id <= 500),
likened AS (
  SELECT n.id, n.o, round(list_sum(list_transform(range(1, 129), lambda i: (sa.signature[i] = sb.signature[i])::INT)) / 128.0::DOUBLE, 6) AS similarity
  FROM near n JOIN signed sa ON sa.id = n.id JOIN signed sb ON sb.id = n.o)
SELECT id, min(o) AS duplicate_of, arg_min(similarity, o) AS similarity FROM likened WHERE similarity >= 0.8 GROUP BY id""")
def near_dup_within_retention(spark, sf_dir):
    """The stream's rule over a table: a document an hour, looked back on for 500 hours."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.timestamp_seconds(F.col("doc_id") * 3600).alias("ts"), F.col("text").alias("content"))
    return near.first_matches(near.near_matches(items, "500 hours"))


@query("exact_dups", """
SELECT md5(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1""")
def exact_dups(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").groupBy(F.md5("text").alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("contamination", f"""WITH {_shingle_sql("ds", "documents", "doc_id", 8)}, {_shingle_sql("bs", "benchmark", "item_id", 8)},
n AS (SELECT id, count(*) AS size FROM bs GROUP BY id)
SELECT * FROM (
  SELECT bs.id AS item_id, ds.id, round(count(*)::DOUBLE / any_value(size), 6) AS share
  FROM ds JOIN bs USING (shingle) JOIN n ON n.id = bs.id GROUP BY bs.id, ds.id) WHERE share >= 0.5""")
def contamination(spark, sf_dir):
    return dedup.contamination(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


AS_OF = "2024-01-31 00:00:00"
#: What event types stand for: priority 1 to 5.
PRIORITY = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}
_PRIO_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 1 END"
_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6 / 3600"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _items(spark, sf_dir):
    prio = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("event_type")], F.lit(1))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"),
                                                  F.round(F.col("value") / 1000, 6).alias("similarity"), prio.alias("priority"))


def _decay_sql(formula: str) -> str:
    return f"SELECT event_id AS id, round(least(CASE WHEN h <= 1 THEN 1.5 * ({formula}) ELSE {formula} END, 1.0), 6) AS time_score FROM (SELECT event_id, {_AGE} AS h FROM events)"


_EXP = "exp(-ln(2) / 24 * h)"
for _name, _kind, _formula in (("time_decay_exp", "exponential", _EXP), ("time_decay_linear", "linear", "greatest(0, 1 - h / 720)"), ("time_decay_log", "logarithmic", "1 / (1 + ln(1 + greatest(h, 0) / 24))")):

    @query(_name, _decay_sql(_formula))
    def time_decay(spark, sf_dir, kind=_kind):
        return _items(spark, sf_dir).select("id", F.round(times.time_score(F.col("ts"), _as_of(), kind), 6).alias("time_score"))


@query("time_weighted_topk", f"""
WITH s AS (SELECT event_id AS id, round(value / 1000, 6) AS similarity, {_PRIO_SQL} AS priority, {_AGE} AS h FROM events WHERE event_type IN ('error', 'purchase')),
t AS (SELECT *, round(least(CASE WHEN h <= 1 THEN 1.5 * {_EXP} ELSE {_EXP} END, 1.0), 6) AS time_score FROM s),
u AS (SELECT id, time_score, round(0.6::DOUBLE * similarity + 0.3::DOUBLE * time_score + 0.1::DOUBLE * priority / 5, 6) AS score FROM t)
SELECT id, time_score, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM u ORDER BY score DESC, id LIMIT 20""")
def time_weighted_topk(spark, sf_dir):
    items = timeindex.select_items(_items(spark, sf_dir), kinds=("error", "purchase"))
    return timeindex.time_weighted(items, _as_of(), 20).select("id", "time_score", "score", "rank")


@query("substring_search", f"""
WITH s AS (SELECT event_id AS id, {_AGE} AS h FROM events WHERE contains(lower(event_type), 'sign')),
t AS (SELECT id, round(0.5::DOUBLE + 0.3::DOUBLE * least(CASE WHEN h <= 1 THEN 1.5 * {_EXP} ELSE {_EXP} END, 1.0), 6) AS score FROM s)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM t ORDER BY score DESC, id LIMIT 15""")
def substring_search(spark, sf_dir):
    return timeindex.substring_search(_items(spark, sf_dir), "kind", "SIGN", _as_of(), 15).select("id", "score", "rank")


@query("recent_n", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_n(spark, sf_dir):
    return state.newest(_items(spark, sf_dir).where("kind <> 'view'"), 25, "ts", "id").select("id", "kind")


@query("time_range", "SELECT event_id AS id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def time_range(spark, sf_dir):
    items = _items(spark, sf_dir)
    return timeindex.in_range(items, F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp")).select("id")


@query("retention", f"""
SELECT id FROM (SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) WHERE r <= 500""")
def retention(spark, sf_dir):
    """Seven days, then the 500 newest."""
    return state.newest(state.retain(_items(spark, sf_dir), "ts", _as_of(), 7), 500, "ts", "id").select("id")


def _event_store(spark, sf_dir) -> TimeStore:
    """Events of a month by day: errors come late, sign-ups later still; then days of
    several segments are compacted and the first week expires."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    store = TimeStore.create(spark, f"{folder(spark)}/events", events.schema)
    store.append(events.where("kind is null or kind not in ('error', 'signup')"))
    store.append(events.where("kind = 'error'"))
    store.compact()
    store.append(events.where("kind = 'signup'"))
    store.expire(datetime.datetime(2024, 1, 8, 9))
    return store


@query("time_store_range", """
SELECT event_id AS id, event_type AS kind, value FROM events
WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-21 18:30:00'""")
def time_store_range(spark, sf_dir):
    """A range of a stored table by day, late rows in, expired days out."""
    return _event_store(spark, sf_dir).in_range(datetime.datetime(2024, 1, 5, 6), datetime.datetime(2024, 1, 21, 18, 30)).select("id", "kind", "value")


@query("time_store_newest", "SELECT event_id AS id, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 400")
def time_store_newest(spark, sf_dir):
    """The newest rows, from the last days of the store on."""
    return _event_store(spark, sf_dir).newest(400).select("id", "kind")


@query("freshness_note", f"""
WITH n AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id), a AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6 AS age FROM n)
SELECT user_id, CASE WHEN age < 60 THEN 'Based on data from the last minute'
  WHEN age < 3600 THEN 'As of ' || CAST(floor(age / 60) AS BIGINT) || ' minute' || CASE WHEN floor(age / 60) = 1 THEN '' ELSE 's' END || ' ago'
  WHEN age < 86400 THEN 'As of ' || CAST(floor(age / 3600) AS BIGINT) || ' hour' || CASE WHEN floor(age / 3600) = 1 THEN '' ELSE 's' END || ' ago'
  ELSE 'As of ' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' END AS note FROM a""")
def freshness_note(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("ts"))
    return newest.select("user_id", times.freshness(F.col("ts"), _as_of()).alias("note"))


VERTICES = """
vertices AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL
  SELECT 'N' || n_nationkey, n_name, 'nation' FROM nation UNION ALL
  SELECT 'S' || s_suppkey, s_name, 'supplier' FROM supplier),
edges AS (
  SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'IN' AS type, 0.8::DOUBLE AS weight FROM nation UNION ALL
  SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED', 0.5::DOUBLE FROM supplier),
two AS (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"""


def _graph(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    v = region.select(key("R", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("type"))
    v = v.unionByName(nation.select(key("N", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("type")))
    v = v.unionByName(supplier.select(key("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type")))
    e = nation.select(key("N", "n_nationkey").alias("source"), key("R", "n_regionkey").alias("target"), F.lit("IN").alias("type"), F.lit(0.8).alias("weight"))
    return v, e.unionByName(supplier.select(key("S", "s_suppkey").alias("source"), key("N", "s_nationkey").alias("target"), F.lit("LOCATED").alias("type"), F.lit(0.5).alias("weight")))


@query("neighbors", f"""WITH {VERTICES}
SELECT e.target AS node, v.id, e.type AS edge, v.name FROM edges e JOIN vertices v ON v.id = e.source WHERE e.type = 'LOCATED'""")
def neighbors(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    asked = v.where("type = 'nation'")
    return graph.neighbours(e, v.select("id", "name"), asked, "LOCATED", outgoing=False).select("node", "id", F.col("type").alias("edge"), "name")


@query("related_within_2", f"""WITH RECURSIVE {VERTICES},
w AS (SELECT 'R0' AS id, 0 AS d UNION ALL SELECT two.target, d + 1 FROM w JOIN two ON two.source = w.id WHERE d < 2)
SELECT id, min(d) AS distance FROM w GROUP BY id HAVING min(d) > 0""")
def related_within_2(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    return graph.within(e, v.where("id = 'R0'").select("id"), 2)


@query("call_path", f"""WITH {VERTICES}
SELECT a.source AS start, b.target AS id, a.source || '>' || a.target || '>' || b.target AS path
FROM edges a JOIN edges b ON b.source = a.target WHERE a.source LIKE 'S%' AND b.target LIKE 'R%'""")
def call_path(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    found = graph.shortest_paths(e, v.where("type = 'supplier'").select("id"), v.where("type = 'region'").select("id"))
    return found.select("start", "id", F.array_join("path", ">").alias("path"))


@query("call_chain", f"""WITH RECURSIVE {VERTICES},
w AS (SELECT ['N3'] AS path, 'N3' AS id UNION ALL SELECT list_append(path, two.target), two.target FROM w JOIN two ON two.source = w.id WHERE len(path) <= 2 AND NOT list_contains(path, two.target))
SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS depth FROM w""")
def call_chain(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    found = graph.chains(graph.both_ways(e), v.where("id = 'N3'").select("id"), 2)
    return found.select(F.array_join("path", ">").alias("path"), "depth")


@query("entity_search", f"""WITH RECURSIVE {VERTICES},
w AS (SELECT id, 1.0::DOUBLE AS score, [id] AS path FROM vertices WHERE id IN ('N1', 'N4') UNION ALL
  SELECT two.target, score * weight * 0.5::DOUBLE, list_append(path, two.target) FROM w JOIN two ON two.source = w.id WHERE len(path) <= 2 AND NOT list_contains(path, two.target))
SELECT id, round(max(score), 6) AS score, array_to_string(arg_min(path, (-round(score, 6), path)), '>') AS path FROM w WHERE len(path) > 1 AND id NOT IN ('N1', 'N4') GROUP BY id""")
def entity_search(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    found = graph.entity_search(e, v.where(F.col("id").isin("N1", "N4")).select("id"), 2)
    return found.select("id", "score", F.array_join("path", ">").alias("path"))


@query("entities_in_question", """
WITH q AS (SELECT n_nationkey AS qid, 'Suppliers of ' || n_name || ' and of ' || r_name AS question FROM nation JOIN region ON r_regionkey = n_regionkey),
e AS (SELECT 'N' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)
SELECT qid, id, lower(name) AS name, n FROM (
  SELECT qid, id, name, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM q JOIN e ON contains(lower(question), lower(name))) WHERE n <= 3""")
def entities_in_question(spark, sf_dir):
    v, e = _graph(spark, sf_dir)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    q = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Suppliers of "), "n_name", F.lit(" and of "), "r_name").alias("question"))
    return graph.named_in(q, v.where("type <> 'supplier'"))


@query("graph_stats", f"""WITH {VERTICES}
SELECT 'vertex' AS part, type, count(*) AS n FROM vertices GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type""")
def graph_stats(spark, sf_dir):
    return graph.stats(*_graph(spark, sf_dir))


@query("ingest_steps", """
WITH fresh AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00'), users AS (SELECT user_id, count(*) AS n FROM fresh GROUP BY user_id),
m AS (
  SELECT 0 AS place, 'read' AS step, unnest(['rows', 'errors', 'value']) AS metric, unnest([count(*), count(*) FILTER (event_type = 'error'), sum(value)]::DOUBLE[]) AS value FROM events
  UNION ALL SELECT 1, 'fresh', unnest(['rows', 'errors']), unnest([count(*), count(*) FILTER (event_type = 'error')]::DOUBLE[]) FROM fresh
  UNION ALL SELECT 2, 'users', unnest(['rows', 'most']), unnest([count(*), max(n)]::DOUBLE[]) FROM users)
SELECT place, step, metric, round(value, 3) AS value FROM m""")
def ingest_steps(spark, sf_dir):
    """What three steps of one job let through, observed while it runs."""
    log, bad = metrics.StepLog(), F.count_if(F.col("event_type") == "error")
    events = log.step("read", table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value"), errors=bad, value=F.sum("value"))
    fresh = log.step("fresh", events.where(F.col("ts").cast("timestamp") >= F.lit("2024-01-11 00:00:00").cast("timestamp")), errors=bad)
    users = log.step("users", fresh.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), most=F.max("n"))
    kept(users)  # the one job
    return log.table(spark).withColumn("value", F.round("value", 3))
