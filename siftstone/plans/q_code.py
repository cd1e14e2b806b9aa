"""Code search over sources that are written from the customers' tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.lineage import kept
from siftstone.operators import scopes, scripts
from siftstone.plans.registry import query, table

_REGION = "class Root:\n    def ping(self):\n        return 1\n    def pong(self):\n        return self.ping()\n\ndef shared():\n    return 1\n"
_NATION = "from core.r#r import Root, shared\n\nclass Base(Root):\n    def run(self):\n        return self.ping()\n"
_ODD = "    def ping(self):\n        return shared()\n"
_CUSTOMER = "from lib.n#n import Base, shared as get\nimport lib.n#n as lib\n\nclass Client(Base):\n    def work(self):\n        get()\n        self.run()\n        self.ping()\n        super().pong()\n        lib.Base()\n\ndef shared():\n    return Client().work()\n"


def _sources(spark, sf_dir):
    """A module a region, a nation and a customer; each imports the one above, and
    passes on what it imports."""
    put = lambda text, mark, c: F.replace(text, F.lit(mark), F.col(c).cast("string"))
    path = lambda folder, c: F.concat(F.lit(folder), F.col(c).cast("string"), F.lit(".py")).alias("path")
    regions = table(spark, sf_dir, "region").select(path("core/r", "r_regionkey"), F.lit(_REGION).alias("source"))
    nation = put(F.lit(_NATION), "#r", "n_regionkey")
    nations = table(spark, sf_dir, "nation").select(path("lib/n", "n_nationkey"), F.concat(nation, F.when(F.col("n_nationkey") % 2 == 1, _ODD).otherwise("")).alias("source"))
    customers = table(spark, sf_dir, "customer").select(path("app/m", "c_custkey"), put(F.lit(_CUSTOMER), "#n", "c_nationkey").alias("source"))
    return regions.unionByName(nations).unionByName(customers)


@query("scoped_calls", """
WITH r AS (SELECT 'core/r' || r_regionkey || '.py::' AS r, r_regionkey FROM region),
n AS (SELECT 'lib/n' || n_nationkey || '.py::' AS n, r, n_nationkey % 2 = 1 AS odd, n_nationkey FROM nation JOIN r ON r_regionkey = n_regionkey),
c AS (SELECT 'app/m' || c_custkey || '.py::' AS c, n, r, odd FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT r || 'Root.pong' AS source, r || 'Root.ping' AS target, 'calls' AS type FROM r
UNION ALL SELECT r || 'Root', r || unnest(['Root.ping', 'Root.pong']), 'contains' FROM r
UNION ALL SELECT n || 'Base.run', CASE WHEN odd THEN n || 'Base.ping' ELSE r || 'Root.ping' END, 'calls' FROM n
UNION ALL SELECT n || 'Base.ping', r || 'shared', 'calls' FROM n WHERE odd
UNION ALL SELECT n || 'Base', r || 'Root', 'extends' FROM n
UNION ALL SELECT n || 'Base', n || 'Base.run', 'contains' FROM n
UNION ALL SELECT n || 'Base', n || 'Base.ping', 'contains' FROM n WHERE odd
UNION ALL SELECT c || 'Client.work', unnest([r || 'shared', n || 'Base.run', CASE WHEN odd THEN n || 'Base.ping' ELSE r || 'Root.ping' END, r || 'Root.pong', n || 'Base']), 'calls' FROM c
UNION ALL SELECT c || 'shared', unnest([c || 'Client', c || 'Client.work']), 'calls' FROM c
UNION ALL SELECT c || 'Client', n || 'Base', 'extends' FROM c
UNION ALL SELECT c || 'Client', c || 'Client.work', 'contains' FROM c""")
def scoped_calls(spark, sf_dir):
    """Calls through imports that are passed on, method orders over three files."""
    return scopes.scoped_edges(kept(_sources(spark, sf_dir)))


_SCRIPT = r"""import { B# } from "./b#";
/* function no() {} */
export function load#(url: string, deep = {}) {
  const s = `function inner() { ${call#(1)} }`;
  if (url && s) { return fetch(url); }
  return /function x\(\) \{/.test(s);
}
export class Shop# extends B# {
  async open(x) { for (const y of x) { load#(y); } }
  get size() { return "}" }
"""


@query("script_units", """
WITH c AS (SELECT c_custkey::VARCHAR AS c, c_nationkey % 3 + 1 AS n FROM customer),
u AS (
  SELECT c, 'load' || c AS name, NULL AS owner, 'function' AS type, 3 AS a, 7 AS b, 'call' || c || ',fetch,test' AS calls, 'url: string,deep = ...' AS parameters, '' AS bases, 3 AS complexity FROM c
  UNION ALL SELECT c, 'Shop' || c, NULL, 'class', 8, 11 + n, 'load' || c, '', 'B' || c, NULL FROM c
  UNION ALL SELECT c, 'open', 'Shop' || c, 'method', 9, 9, 'load' || c, 'x', '', 2 FROM c
  UNION ALL SELECT c, 'size', 'Shop' || c, 'property', 10, 10, '', '', '', 1 FROM c
  UNION ALL SELECT c, 'k' || i, 'Shop' || c, 'method', 10 + i, 10 + i, 'load' || c, '', '', 1 FROM (SELECT c, unnest(range(1, n + 1)) AS i FROM c)
  UNION ALL SELECT c, 'twice' || c, NULL, 'function', 12 + n, 12 + n, 'load' || c, 'x', '', 1 FROM c)
SELECT 'web/m' || c || '.ts::' || coalesce(owner || '.', '') || name AS id, name, type, a::INT AS start_line, b::INT AS end_line, owner AS parent_class, calls, parameters, bases, complexity::INT AS complexity FROM u""")
def script_units(spark, sf_dir):
    """Units of TypeScript sources, one a customer, with as many methods as its nation says."""
    text = lambda s: F.replace(F.lit(s), F.lit("#"), F.col("c_custkey").cast("string"))
    lines = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_nationkey") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("  k"), i.cast("string"), F.lit("() { load"), F.col("c_custkey").cast("string"), F.lit("(1); }\n"))), "")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("web/m"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(text(_SCRIPT), lines, text("}\nexport const twice# = x => load#(x);\n")).alias("source"))
    joined = {c: F.array_join(c, ",") for c in ("calls", "parameters", "bases")}
    return scripts.parse_scripts(files).withColumns(joined).select("id", "name", "type", "start_line", "end_line", "parent_class", "calls", "parameters", "bases", "complexity")
