"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], here a line
from ``1 - slope`` to ``1 + slope`` times its mean.  Its integral, scaled to
the source's target, is the source's cumulative token demand
``D(t) = target * ((1 - slope) * t + slope * t * t)``.  A source supplies its
documents in a seeded order, again and again for at most ``most`` passes; the
copy whose middle word is number u of that supply gets training position
``D^-1(u)``, and copies beyond ``D(1)`` are not taken.  Sorting by position
(a range sort, ties by id, text hash and copy) gives the training order; a
stored table keeps it in its files' and rows' order, which ``read_order`` reads
back.

Targets: weights 1, 2, 3, 1, ... by the source's name share all words; a target
stops at ``most`` times its source's size and the rest is shared again by
weight (water filling, in closed form over sources ordered by size per weight).

The running supply of a source is a two-level sum: each source is cut into
ranges of the seeded order, as many as the input's size asks for, so a hot source
is many small groups; how many changes no result.

Rows: a null or wordless text has size 0 and is taken with 0 words; a source
without words deals its rows out over the whole training by their seeded order;
a null source is a source of its own, ordered last; ties of the seeded order break
by id and text; repeated rows are each kept.  Columns of the input pass through;
of those that a result column replaces by name, ``plan_mix`` says which.  An empty
table gives an empty result.  A text counts by its words, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Store, col, free, shuffle_width

MOST = 3
WEIGHTS = (1, 2, 3)
#: Least number of ranges of a source, and ranges for each shuffle partition.
SLICES, SLICES_EACH = 1024, 16
#: As many files may be broadcast with their first rank; more are joined by a shuffle.
FEW_FILES = 10_000
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` has one row a source (source, source_size); adds weight,
    target and slope."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(ordered) - 1
    out = sizes.withColumn("nth", nth)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    full = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumns({"cap": most * F.col("source_size"), "all_size": F.sum("source_size").over(full), "all_weight": F.sum("weight").over(full)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)), "rank": F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "nth"))})
    out = out.withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    out = out.withColumn("over", F.col("weight") * F.col("level") >= F.col("cap"))
    # From the first source that stays below its cap on, that level holds for all.
    first = F.min(F.when(~F.col("over"), F.struct("rank", "level"))).over(full)
    out = out.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    slope = F.when(F.col("nth") % 2 == 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    return out.select("source", "source_size", "weight", target.alias("target"), slope.alias("slope"))


MADE = ("size", "source_size", "target", "taken", "positions")


def _planned(docs: DataFrame, into: str, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """``docs`` and the column ``into``, a struct of MADE and of ``tie``, a hash
    of the text."""
    key, order, part, mine, tie, upto = free(docs.withColumn(into, F.lit(0)), "mix_key", "mix_order", "mix_slice", "mix_size", "mix_tie", "mix_upto")
    slices = max(SLICES, SLICES_EACH * shuffle_width(docs))
    text = col(text_col)
    sized = docs.withColumns({
        key: F.coalesce(F.concat(F.lit("s"), col(source_col)), F.lit("")),
        order: F.md5(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}"))),
        mine: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
        tie: F.xxhash64(text),
    })
    share = F.conv(F.substring(F.col(order), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    sized = sized.withColumn(part, (share * slices).cast("int"))
    ranges = sized.groupBy(F.col(key).alias("k"), F.col(part).alias("p")).agg(F.sum(mine).alias("n"))
    source = F.when(F.col("k") != "", F.substring(F.col("k"), 2, 2**31 - 1)).alias("source")
    targets = source_targets(ranges.groupBy("k").agg(F.sum("n").alias("source_size")).select(source, "source_size"), weights, most)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("k"), "source_size", "target", "slope")
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranges = ranges.join(targets, "k").select(F.struct("offset", "source_size", "target", "slope").alias(upto), F.col("k").alias(key), F.col("p").alias(part))
    inner = Window.partitionBy(key, part).orderBy(order, col(id_col), mine, tie).rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn(into, F.coalesce(F.sum(mine).over(inner), F.lit(0)))
    out = run.join(ranges, [key, part])
    at = F.col(f"{upto}.offset") + F.col(into) + F.col(mine) / 2
    target, slope = F.col(f"{upto}.target"), F.col(f"{upto}.slope")
    copies = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda c: at + c * F.col(f"{upto}.source_size"))
    copies = F.filter(copies, lambda u: u <= target)
    invert = lambda x: (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope)
    positions = F.transform(copies, lambda u: F.when(target > 0, invert(u / target)).otherwise(share))
    made = F.struct(F.col(mine).alias("size"), F.col(f"{upto}.source_size").alias("source_size"), target.alias("target"), (F.col(mine) * F.size(copies)).alias("taken"), positions.alias("positions"), F.col(tie).alias("tie"))
    return out.select(*(col(c) for c in docs.columns), made.alias(into))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Adds to every document ``size``, ``source_size``, ``target``, ``taken``
    (words taken, copies counted) and ``positions`` (ascending, one a copy);
    they replace columns of these names."""
    base = docs.drop(*MADE)
    (into,) = free(base, "mixed")
    out = _planned(base, into, id_col, text_col, source_col, weights, most, seed)
    return out.select(*(col(c) for c in base.columns), *(F.col(f"{into}.{m}").alias(m) for m in MADE))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, with_position: bool = True) -> DataFrame:
    """The training order: the columns of ``docs``, one row a taken copy,
    range-sorted by position; with ``position`` as a column (which replaces one
    of that name), unless it is not wanted."""
    base = docs.drop("position") if with_position else docs
    into, copy, at = free(base, "mixed", "mix_copy", "mix_at")
    out = _planned(base, into, id_col, text_col, source_col, weights, most, seed)
    rows = out.select(*(col(c) for c in base.columns), F.col(f"{into}.tie").alias(into), F.posexplode(F.col(f"{into}.positions")).alias(copy, at))
    rows = rows.orderBy(at, F.coalesce(col(id_col).cast("long"), F.lit(2**63 - 1)), into, copy)
    return rows.select(*(col(c) for c in base.columns), *([F.col(at).alias("position")] if with_position else []))


def rank_first_copies(planned: DataFrame, store: Store, id_col: str = "doc_id", tie_col: str = "tie") -> DataFrame:
    """``planned`` (slim rows with ``positions``) with ``first_rank``: how many
    copies come before the first copy of the row in the training order, or null
    where none is taken; ``positions`` become ``n_copies``, ``first_position``
    and ``last_position``.

    Copies are dealt into ranges of positions; a range's first rank is the
    number of copies in the ranges before it."""
    kept = store.keep(planned)
    parts = SLICES_EACH * shuffle_width(kept)
    names = [c for c in kept.columns if c != "positions"]
    ends = F.struct(F.size("positions").cast("long").alias("n_copies"), F.get("positions", F.lit(0)).alias("first_position"), F.get("positions", F.size("positions") - 1).alias("last_position")).alias("ends")
    rows = kept.select(*(col(c) for c in names), ends, F.posexplode_outer("positions").alias("copy", "at"))
    # Rows without a copy form ranges of their own, below 0.
    spread = -1 - F.pmod(F.xxhash64(id_col, tie_col), F.lit(parts)).cast("long")
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("at") * parts), spread))
    counts = rows.where("at is not null").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy("at", F.coalesce(col(id_col).cast("long"), F.lit(2**63 - 1)), tie_col, "copy")
    ranked = rows.withColumn("nth", F.row_number().over(order)).where("copy is null or copy = 0")
    out = ranked.join(before, "range", "left").withColumn("first_rank", F.when(F.col("at").isNotNull(), F.col("before") + F.col("nth") - 1))
    return out.select(*(col(c) for c in names), "ends.*", "first_rank")


def read_order(rows: DataFrame, into: str = "rank") -> DataFrame:
    """Adds to a table that was written in order (as by ``mix``) each row's rank
    in it: files by their task's number, rows as they lie in a file.  Tables
    without files (as in tests) are taken in their partitions' order, with ranks
    that ascend but skip numbers."""
    from pyspark.errors import AnalysisException

    try:
        held = rows.select("*", F.col("_metadata.file_name").alias("of_file"), F.col("_metadata.row_index").alias("in_file"))
        held.schema  # analysed here
    except AnalysisException:
        return rows.withColumn(into, F.monotonically_increasing_id())
    name, at, first = free(rows, "of_file", "in_file", "first_rank")
    held = rows.select("*", F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(at))
    files = rows.select(F.col("_metadata.file_name").alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    nth = [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long"), F.col(name)]
    firsts = files.select(name, F.coalesce(F.sum("n").over(Window.orderBy(*nth).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    if len(rows.inputFiles()) <= FEW_FILES:
        firsts = F.broadcast(firsts)
    return held.join(firsts, name).withColumn(into, F.col(first) + F.col(at)).drop(name, at, first)


def op8_query(spark, sf_dir: str) -> DataFrame:
    """One row a document: what the contract asks for, and its place in the
    training order."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = _planned(docs, "mixed", "doc_id", "text", "source", WEIGHTS, MOST, SEED).select("doc_id", "mixed.*")
    return rank_first_copies(planned, Store(spark)).drop("tie")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS ord,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1 AS nth
  FROM sized GROUP BY source),
w AS (SELECT *, nth % 3 + 1 AS weight, 3 * source_size AS cap, CASE WHEN nth % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM src),
f AS (
  SELECT *, row_number() OVER o AS rank,
    (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, nth)),
g AS (SELECT *, CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level FROM f),
first_free AS (SELECT rank, level FROM g WHERE weight * level < cap ORDER BY rank LIMIT 1),
t AS (
  SELECT source, source_size, slope,
    CASE WHEN (SELECT count(*) FROM first_free) = 0 OR rank < (SELECT rank FROM first_free) THEN CAST(cap AS DOUBLE)
         ELSE weight * (SELECT level FROM first_free) END AS target
  FROM g),
r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.slope, CAST('0x' || s.ord[1:8] AS BIGINT) / 4294967296::DOUBLE AS share,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + s.size / 2::DOUBLE AS u
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, c, CASE WHEN target > 0 THEN (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((u + c * source_size) / target)) - (1 - slope)) / (2 * slope) ELSE share END AS pos
  FROM r, (SELECT unnest([0, 1, 2]) AS c) WHERE u + c * source_size <= target),
ranked AS (SELECT *, row_number() OVER (ORDER BY pos, doc_id, c) - 1 AS rank FROM copies),
per_doc AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, min(rank) FILTER (c = 0) AS k FROM ranked GROUP BY doc_id)
SELECT r.doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken,
  coalesce(n, 0) AS n_copies, a AS first_position, b AS last_position, k AS first_rank
FROM r LEFT JOIN per_doc p ON r.doc_id = p.doc_id
"""
