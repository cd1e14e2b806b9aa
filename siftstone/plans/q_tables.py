"""Queries of the table engine, joins and state maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.operators import state, tables
from siftstone.plans.registry import query, table
from siftstone.sources.tables import json_rows


@query("table_filter_ops", """
SELECT '==' AS op, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT '!=', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL
SELECT '>', count(*) FROM orders WHERE o_totalprice > 150000 UNION ALL
SELECT '>=', count(*) FROM orders WHERE o_totalprice >= 150000 UNION ALL
SELECT '<', count(*) FROM orders WHERE o_totalprice < 50000 UNION ALL
SELECT '<=', count(*) FROM orders WHERE o_totalprice <= 50000
""")
def table_filter_ops(spark, sf_dir):
    """All comparisons in one scan."""
    orders = table(spark, sf_dir, "orders")
    asked = [("==", "o_orderstatus", "F"), ("!=", "o_orderstatus", "F"), (">", "o_totalprice", 150000), (">=", "o_totalprice", 150000), ("<", "o_totalprice", 50000), ("<=", "o_totalprice", 50000)]
    counted = orders.agg(*(F.count_if(tables.predicate(c, op, v)).alias(op) for op, c, v in asked))
    pairs = F.array(*(F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("n")) for op, _, _ in asked))
    return counted.select(F.inline(pairs))


@query("table_contains", r"""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)(RING|bolt)$')""")
def table_contains(spark, sf_dir):
    return tables.TableQuery(table(spark, sf_dir, "part")).filter("p_name", "contains", "(RING|bolt)$").select("p_partkey", "p_name").df


@query("table_aggregate", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS mean_price,
  min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_supp
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def table_aggregate(spark, sf_dir):
    a = tables.aggregate
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(a("l_quantity", "sum"), 2).alias("sum_qty"), F.round(a("l_extendedprice", "mean"), 2).alias("mean_price"),
        a("l_discount", "min").alias("min_disc"), a("l_tax", "max").alias("max_tax"), a("l_quantity", "count").alias("n_rows"), a("l_suppkey", "unique").alias("n_supp"))


@query("table_rollup", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def table_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("table_sort_head", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10")
def table_sort_head(spark, sf_dir):
    return tables.TableQuery(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).sort("c_acctbal", False, "c_custkey").head(10).df


@query("table_infer_types", """
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)$') THEN 'double'
    WHEN regexp_matches(x, '^[+-]?[0-9]+(_[0-9]+)*$') THEN 'bigint' ELSE 'string' END AS kind
  FROM (
    SELECT trim(regexp_replace(c, '[,$%]', '', 'g')) AS x FROM (
      SELECT '$' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) || '.50' AS c FROM orders UNION ALL
      SELECT CAST(o_orderkey AS VARCHAR) || '%' FROM orders UNION ALL
      SELECT o_orderpriority FROM orders)))
GROUP BY kind""".replace("\\\\", "\\"))
def table_infer_types(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cells = orders.select(F.explode(F.array(
        F.concat(F.lit("$"), F.round("o_totalprice").cast("bigint").cast("string"), F.lit(".50")),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("%")), F.col("o_orderpriority"))).alias("c"))
    return cells.groupBy(tables.cell_type(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("table_chunk", """
WITH r AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderpriority, i // 50 AS chunk_index, min(i) AS start_row, max(i) + 1 AS end_row, count(*) AS n_rows,
  CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total_rows
FROM r GROUP BY o_orderpriority, i // 50""")
def table_chunk(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.row_number().over(w).cast("bigint") - 1).alias("row_idx"))
    return tables.chunk_table(rows, "row_idx", 50, "o_orderpriority")


@query("table_group_stats", """
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users
FROM events GROUP BY event_type""")
def table_group_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("users"))


@query("source_type_counts", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source, lang")
def source_type_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("json_cells", """SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events""")
def json_cells(spark, sf_dir):
    rows = json_rows(table(spark, sf_dir, "events"), "props", "k bigint")
    return rows.select("event_id", F.coalesce("k", F.lit(0)).alias("k"))


@query("pad_rows", """
SELECT o_orderkey, array_to_string(list_slice(list_concat(string_split(o_orderpriority, '-'), ['', '', '']), 1, 3), '|') AS cells FROM orders""")
def pad_rows(spark, sf_dir):
    from siftstone.functions.text import pad_row

    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(pad_row(F.split("o_orderpriority", "-"), 3), "|").alias("cells"))


@query("hydrate_join", """
SELECT o_orderkey, o_totalprice, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) JOIN customer ON c_custkey = o_custkey""")
def hydrate_join(spark, sf_dir):
    """Hits (a hundred rows) find their records; hits without one drop out."""
    hits = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return people.join(F.broadcast(hits), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_totalprice", "c_name")


@query("anti_seen", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_seen(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("upsert_latest", """
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return state.latest(events, ["user_id"], ["ts", "event_id"])


@query("delete_by_id", """
SELECT e.event_id, e.event_type FROM events e WHERE e.event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""")
def delete_by_id(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return state.delete(events, events.where("event_type = 'error'").select("event_id"), "event_id")


@query("export_json", """
SELECT n_nationkey, '{"id":' || n_nationkey || ',"label":"' || n_name || '","group":' || n_regionkey || '}' AS node FROM nation""")
def export_json(spark, sf_dir):
    from siftstone.operators import graph

    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("group"))
    return graph.export(nodes, nodes)[0].select(F.get_json_object("json", "$.id").cast("int").alias("n_nationkey"), F.col("json").alias("node"))


@query("full_outer_ids", """
SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_outer_ids(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nationkey", "full_outer").na.fill(0)


@query("describe_table", """
SELECT (SELECT count(*) FROM orders) AS n_rows, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY column_index) AS columns, least(3, (SELECT count(*) FROM orders)) AS n_sample
FROM duckdb_columns() WHERE table_name = 'orders'""")
def describe_table(spark, sf_dir):
    told = tables.TableQuery(table(spark, sf_dir, "orders")).describe()
    return spark.createDataFrame([(told["rows"], len(told["columns"]), ",".join(told["columns"]), len(told["sample"]))], "n_rows long, n_columns long, columns string, n_sample long")
