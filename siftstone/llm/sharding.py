"""Sharding by minimax contiguous partition.

Rows of equal text are one atomic group.  Groups stand in the order of their least
id, and each shard takes a run of them.  The smallest capacity for which the shards
suffice is found by binary search; a capacity is checked greedily: a shard ends at
the last group end within the capacity, or after one group that is larger (such a
group has its shard to itself, so it does not let all others grow to its size).  Both
the greedy end and the count are monotone in the capacity, so the search is exact:
the largest shard is as small as any contiguous partition can make it.

The groups' ends are never gathered.  They are cumulative sizes in a stored table;
the search sees, of at most ``CELLS`` equal cells of the range that matters, the first
and the last end in each.  With these every greedy check has a lower and an upper
result.  Capacities that are feasible by the lower one and infeasible by the upper one
bound the answer, and with it where each cut can lie; the next round cuts those
windows into as many cells, until all is exact (a few rounds at any size, each a scan
of the windows' part of the table).  Greedy cuts leave the last shard what is left, so
within the capacity each cut then moves to the known end that is nearest to an equal
share of the rest (``evened``).

Cumulative sizes come from one range sort by (least id, text hash, id): a hot group
of copies is spread over ranges, whose sums are added up afterwards.

Rows: a null text is like an empty one (size 8, crc32 0, one group); a null id comes
last; ties and repeated rows keep places next to each other; texts count whole,
however long; other columns pass through ``shard_documents``, those named like a result
are replaced.  Fewer groups than shards leave shards empty; an empty table gives an
empty result.  Groups are told apart by the md5 of their text, so two texts of one
hash would only be kept together.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, col, free, shuffle_width, table

SHARDS, BESIDES = 24, 8
#: Cells in which a round of the search sees group ends; bounds what the driver holds.
CELLS = 1 << 15


class Ends:
    """What is known of the sorted group ends: the first and last end in each cell.
    Between those two there may be more; elsewhere there is none."""

    def __init__(self, cells: list[tuple[int, int]]):
        self.first, self.last = [c[0] for c in cells], [c[1] for c in cells]

    def upto(self, x: int) -> tuple[int, int]:
        """Bounds of the last end at or before x (0: none)."""
        i = bisect.bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        if x >= self.last[i]:
            return self.last[i], self.last[i]
        return self.first[i], x

    def after(self, x: int) -> tuple[int, int]:
        """Bounds of the first end after x."""
        i = bisect.bisect_right(self.last, x)
        if i == len(self.last):
            return self.last[-1], self.last[-1]
        return (self.first[i], self.first[i]) if x < self.first[i] else (x + 1, self.last[i])

    def greedy(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of each shard's end."""
        low = high = 0
        out = []
        for _ in range(shards):
            low = max(self.upto(low + capacity)[0], self.after(low)[0]) if low < self.last[-1] else low
            high = max(self.upto(high + capacity)[1], self.after(high)[1]) if high < self.last[-1] else high
            out.append((low, high))
        return out


def least(of, low: int, high: int) -> int:
    """The smallest number in [low, high] for which ``of`` holds; it holds for high."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if of(mid) else (mid + 1, high)
    return low


def windows(spans: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """Merged spans of ends, [low, high] each."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, min(high, total)])
    return [(a, b) for a, b in out]


def seen(ends: DataFrame, spans: list[tuple[int, int]], cells: int) -> list[tuple[int, int]]:
    """(first, last) end in each cell of the spans that has one.  ``ends`` has a
    column ``upto``.  At most ``cells`` rows come to the driver, whatever the size."""
    width = -(-sum(b - a + 1 for a, b in spans) // max(1, cells - len(spans)))
    cell, before = F.lit(None).cast("long"), 0
    within = F.lit(False)
    for a, b in spans:
        inside = F.col("upto").between(a, b)
        within = within | inside
        cell = F.when(inside, before + F.expr(f"(upto - {a}) div {width}")).otherwise(cell)
        before += -(-(b - a + 1) // width)
    found = ends.where(within).groupBy(cell.alias("cell")).agg(F.min("upto").alias("a"), F.max("upto").alias("b"))
    return sorted((r.a, r.b) for r in found.collect())


def evened(known: list[int], capacity: int, shards: int) -> list[int]:
    """Ends, all of them known ones, as near to equal shards as the capacity lets
    them.  Known are sorted ends, the greedy ones and the total among them, and the
    start and end of each group that is larger than the capacity."""
    total, least_end = known[-1], [known[-1]]
    for _ in range(shards - 1):  # backwards: where each shard must end at the earliest
        i = bisect.bisect_left(known, least_end[-1])
        before = known[i - 1] if i else 0
        j = bisect.bisect_left(known, least_end[-1] - capacity)
        least_end.append(0 if least_end[-1] <= capacity else min(before, known[j]))
    out, at = [], 0
    for left, earliest in zip(range(shards, 0, -1), reversed(least_end)):
        if at < total:
            i, j = bisect.bisect_right(known, at), bisect.bisect_right(known, at + capacity)
            own = [x for x in known[i : max(j, i + 1)] if x >= earliest]
            at = min(own, key=lambda x: (abs((x - at) * left - (total - at)), x))
        out.append(at)
    return out


def capacity(ends: DataFrame, total: int, shards: int = SHARDS, cells: int = CELLS) -> tuple[int, list[int]]:
    """The smallest capacity, and each shard's end within it.  ``ends`` (column
    ``upto``) holds every group's end once or more; the last is ``total``."""
    low, high, spans, wide, whole = 1, total, [(1, total)], 2 * total, None
    while True:
        length = sum(b - a + 1 for a, b in spans)
        if 2 * length > wide:  # too few cells for so many shards
            cells *= 4
        wide = length
        # Outside the windows nothing matters but that the total is an end.
        known = seen(ends, spans, cells)
        if known[-1][1] != total:
            known.append((total, total))
        whole = whole or known
        at = Ends(known)
        fits = lambda c, side: at.greedy(c, shards)[-1][side] == total
        high = least(lambda c: fits(c, 0), low, high)  # surely feasible
        low = least(lambda c: fits(c, 1), low, high)  # below it surely not
        cuts, first = at.greedy(high, shards), at.greedy(low, shards)
        if low == high and all(a == b for a, b in cuts):
            return high, evened(sorted({x for c in whole for x in c} | {a for a, _ in cuts}), high, shards)
        spans = windows([(a[0], b[1]) for a, b in zip(first, cuts)], total)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, over a task's rows: cumulative size and count, whether another group
    follows (unknown for the last row: false)."""
    size = n = 0
    held: pa.RecordBatch | None = None

    def given(batch: pa.RecordBatch, follows: str | None) -> pa.RecordBatch:
        nonlocal size, n
        sums = np.cumsum(np.asarray(batch.column("shard_size"), np.int64)) + size
        counts = np.arange(1, batch.num_rows + 1) + n
        keys = batch.column("shard_group").to_pylist()
        ends = [a != b for a, b in zip(keys, keys[1:])] + [follows is not None and keys[-1] != follows]
        size, n = int(sums[-1]), int(counts[-1])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums), pa.array(counts), pa.array(ends)], [*batch.schema.names, "shard_sum", "shard_count", "shard_end"])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield given(held, batch.column("shard_group")[0].as_py())
            held = batch
    if held is not None:
        yield given(held, None)


def placed(docs: DataFrame, store: Store, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(shard_id, shard_size, shard_crc, shard_row, upto, nth, shard_end) of each row
    in order: ``upto`` and ``nth`` are the cumulative size and count with it;
    and the total size.  ``docs`` needs the column ``shard_row``, its own number."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("shard_id"), (F.octet_length(text) + BESIDES).cast("long").alias("shard_size"), F.crc32(text.cast("binary")).alias("shard_crc"), F.md5(text).alias("shard_group"), "shard_row")
    rows = store.keep(rows)
    # Only copies need their group's least id; the join is skewed by hot groups, which AQE splits.
    copies = rows.groupBy("shard_group").agg(F.min("shard_id").alias("shard_first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = F.coalesce("shard_first", "shard_id")
    rows = rows.join(copies, "shard_group", "left").select("shard_id", "shard_size", "shard_crc", "shard_group", "shard_row", first.alias("shard_first"))
    order = (F.col("shard_first").asc_nulls_last(), "shard_group", F.col("shard_id").asc_nulls_last(), "shard_row")
    ranges = rows.repartitionByRange(shuffle_width(rows), *order).sortWithinPartitions(*order).withColumn("shard_range", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema)
    stored = store.keep(ranges.mapInArrow(_running, f"{kinds}, shard_sum long, shard_count long, shard_end boolean"))
    # A row a range: what came before it, and whether its last row ends its group.
    parts = stored.groupBy("shard_range").agg(F.max("shard_sum").alias("size"), F.max("shard_count").alias("n"), F.min_by("shard_group", "shard_count").alias("a"), F.max_by("shard_group", "shard_count").alias("b"))
    size = n = 0
    added, ordered = [], sorted(parts.collect())
    for p, after in zip(ordered, [*ordered[1:], None]):
        added.append((p.shard_range, size, n, p.n, after is None or after.a != p.b))
        size, n = size + p.size, n + p.n
    before = docs.sparkSession.createDataFrame(added, "shard_range int, size_before long, n_before long, n_here long, closes boolean")
    out = stored.join(F.broadcast(before), "shard_range")  # a row a range
    return out.select(
        "shard_id", "shard_size", "shard_crc", "shard_row", (F.col("shard_sum") + F.col("size_before")).alias("upto"), (F.col("shard_count") + F.col("n_before")).alias("nth"),
        (F.col("shard_end") | F.col("closes") & (F.col("shard_count") == F.col("n_here"))).alias("shard_end")), size


def assigned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """(shard_id, shard_size, shard_crc, shard_row, shard, slot) of each row."""
    store = Store(docs.sparkSession)
    rows, total = placed(docs, store, id_col, text_col)
    rows = store.keep(rows)
    if not total:
        return rows.select("shard_id", "shard_size", "shard_crc", "shard_row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    _, cuts = capacity(rows.where("shard_end").select("upto"), total, shards, cells)
    starts = [0, *cuts[:-1]]
    counts = {r.upto: r.nth for r in rows.where(F.col("upto").isin(sorted(set(cuts)))).select("upto", "nth").collect()} | {0: 0}
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in reversed(range(shards)):
        here = F.col("upto") <= cuts[k]
        shard, slot = F.when(here, k).otherwise(shard), F.when(here, F.col("nth") - 1 - counts[starts[k]]).otherwise(slot)
    return rows.select("shard_id", "shard_size", "shard_crc", "shard_row", shard.alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` with size, shard and slot."""
    made = ("size", "shard", "slot")
    base = docs.select(*(col(c) for c in docs.columns if c.lower() not in made))
    (row,) = free(base, "shard_row_")
    store = Store(docs.sparkSession)
    numbered = store.keep(base.withColumn(row, F.monotonically_increasing_id()))
    placed_ = assigned(numbered.select(col(id_col), col(text_col), F.col(row).alias("shard_row")), id_col, text_col, shards)
    (key,) = free(numbered, "shard_row")
    found = placed_.select(F.col("shard_row").alias(key), F.col("shard_size").alias("size"), "shard", "slot")
    return numbered.join(found, F.col(row) == F.col(key)).drop(row, key)


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).cast("long").alias("shard_row"))
    out = assigned(docs)
    return out.select(F.col("shard_id").alias("doc_id"), F.col("shard_size").alias("size"), F.col("shard_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows for documents with distinct ids.
OP12_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS t),
sized AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {BESIDES} AS size, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS first FROM documents),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM sized),
sums AS (SELECT doc_id, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM bytes, crc),
ordered AS MATERIALIZED (SELECT doc_id, size, first, sum(size) OVER (ORDER BY first, doc_id)::BIGINT AS upto, row_number() OVER (ORDER BY first, doc_id) AS nth FROM sized),
ends AS MATERIALIZED (SELECT list(e ORDER BY e) AS ps, max(e) AS total FROM (SELECT max(upto) AS e FROM ordered GROUP BY first)),
search AS (
  SELECT 1::BIGINT AS low, total AS high, total FROM ends
  UNION ALL
  SELECT CASE WHEN reach = total THEN low ELSE mid + 1 END, CASE WHEN reach = total THEN mid ELSE high END, total
  FROM (
    SELECT low, high, s.total, (low + high) // 2 AS mid, list_reduce(range({SHARDS}), lambda a, k: CASE WHEN a >= s.total THEN a ELSE greatest(
      list_max(list_filter(ps, lambda p: p <= a + (low + high) // 2)), list_min(list_filter(ps, lambda p: p > a))) END, 0::BIGINT) AS reach
    FROM search s, ends WHERE low < high)),
greedy AS (
  SELECT 0::BIGINT AS a, c, ps, total FROM ends, (SELECT min(high) AS c FROM search)
  UNION ALL
  SELECT greatest(list_max(list_filter(ps, lambda p: p <= a + c)), list_min(list_filter(ps, lambda p: p > a))), c, ps, total FROM greedy WHERE a < total),
cells AS (SELECT min(e) AS low, max(e) AS high FROM (SELECT unnest(ps) AS e, total FROM ends) GROUP BY (e - 1) // ((total + {CELLS - 2}) // {CELLS - 1})),
known AS MATERIALIZED (
  SELECT list(e ORDER BY e) AS ps, max(e) AS total, (SELECT min(high) FROM search) AS c FROM (SELECT low AS e FROM cells UNION SELECT high FROM cells UNION SELECT a FROM greedy WHERE a > 0)),
earliest AS (
  SELECT {SHARDS} AS k, total AS e FROM known
  UNION ALL
  SELECT k - 1, CASE WHEN e <= c THEN 0 ELSE least(coalesce(list_max(list_filter(ps, lambda p: p < e)), 0), list_min(list_filter(ps, lambda p: p >= e - c))) END FROM earliest, known WHERE k > 1),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS a, 0::BIGINT AS b FROM known
  UNION ALL
  SELECT cuts.k + 1, b, CASE WHEN b >= total THEN b ELSE list_min(list_transform(
      list_filter(ps, lambda p: p > b AND p >= e AND (p <= b + c OR p = list_min(list_filter(ps, lambda o: o > b)))),
      lambda p: {{'far': abs((p - b) * ({SHARDS} - cuts.k) - (total - b)), 'p': p}})).p END
  FROM cuts JOIN earliest ON earliest.k = cuts.k + 1, known),
held AS (SELECT doc_id, size, k, nth FROM ordered JOIN cuts ON upto > a AND upto <= b)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, (k - 1)::INTEGER AS shard, row_number() OVER (PARTITION BY k ORDER BY nth) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM held JOIN sums USING (doc_id)
"""
