"""Centroid clustering by Yinyang grouping.

Lloyd's rounds on integer vectors, with exact results.  The starting centroids are
clustered into groups once.  Every vector keeps an upper bound of the distance to its
own centroid and, for each group, a lower bound of the distance to the group's other
centroids.  After the centroids have moved, the bounds are loosened by how far (a
group's by its farthest move); a vector whose upper bound is below all lower bounds
stays without a distance being computed; otherwise its upper bound is made exact and
tested again, then group by group, and only the centroids of groups that pass are
scanned.  Distances are integers; bounds are their roots with a margin for rounding,
and only a bound that is strictly better saves a scan, so that ties are always
decided exactly (by the smaller number).

The vectors with their bounds are a table that each round reads and writes (the one
before is deleted); sums of a cluster are combined in each task and come together as
one row a task and cluster.  The driver holds only centroids: k rows, and a row a
cluster of their sums.

Rows: vectors of another length, or with a null or non-finite component, are left out;
a null id is kept but does not start a centroid (without any id there are no
centroids and no result); repeated rows are vectors of their
own, and ties of the start's order break by the vector; fewer vectors than k give
as many centroids; an empty table gives an empty result; other columns are ignored.  Components
beyond ``LARGEST`` after scaling would not leave distances in 64 bits and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, table

WIDTH, SCALE, K, ROUNDS = 64, 256, 40, 5
#: Centroids in a group, on average.
EACH = 10
LARGEST = 1 << 27
#: Vectors that meet the centroids at once.
CHUNK = 4096
#: Relative error that the roots of distances are given.
MARGIN = 1e-12


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors, components as floor(scale * x)."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = (F.size(vector_col) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, fits).alias("v"))


def start(kept: DataFrame, k: int, seed: str = "2") -> np.ndarray:
    """The k vectors with the smallest hash of their id."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(by.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), len(first[0].v) if first else 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c."""
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each centroid, by a few rounds over the centroids."""
    middles = centroids[:: max(1, len(centroids) // groups)][:groups].astype(float)
    for _ in range(5):
        near = np.array([((middles - c) ** 2).sum(1).argmin() for c in centroids])
        middles = np.stack([centroids[near == g].mean(0) if (near == g).any() else middles[g] for g in range(len(middles))])
    return np.unique(near, return_inverse=True)[1]


class Bounds:
    """A chunk of vectors with what is known of their distances."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.x, self.cluster, self.upper, self.lower = x, cluster, upper, lower
        self.scanned = 0

    def moved(self, drift: np.ndarray, group: np.ndarray) -> None:
        self.upper = (self.upper + drift[self.cluster]) * (1 + MARGIN)
        most = np.array([drift[group == g].max() for g in range(self.lower.shape[1])])
        self.lower = self.lower - most * (1 + MARGIN)
        self.lower -= np.abs(self.lower) * MARGIN

    def assign(self, centroids: np.ndarray, group: np.ndarray) -> None:
        """Give each vector its nearest centroid, scanning only where bounds allow another."""
        open_ = np.flatnonzero(self.upper >= self.lower.min(1))  # the global filter
        own = np.zeros(len(self.x), np.int64)
        own[open_] = ((self.x[open_] - centroids[self.cluster[open_]]) ** 2).sum(1)
        self.upper[open_] = np.sqrt(own[open_]) * (1 + MARGIN)
        self.scanned += len(open_)
        open_ = open_[self.upper[open_] >= self.lower[open_].min(1)]
        if not len(open_):
            return
        before = self.cluster[open_].copy()
        best, number = own[open_].copy(), before.copy()
        limit = self.upper[open_]
        tested = limit[:, None] >= self.lower[open_]  # the group filter
        of = {}
        for g in range(self.lower.shape[1]):
            at, members = np.flatnonzero(tested[:, g]), np.flatnonzero(group == g)
            if len(at):
                d = squared(self.x[open_[at]], centroids[members])
                self.scanned += d.size
                of[g] = at, members, d
                near = d.argmin(1)  # the first of equals
                there, who = d[np.arange(len(at)), near], members[near]
                better = (there < best[at]) | ((there == best[at]) & (who < number[at]))
                best[at[better]], number[at[better]] = there[better], who[better]
        # The centroid that was left counts for its own group again.
        left = np.flatnonzero(number != before)
        root = np.sqrt(own[open_[left]]) * (1 - MARGIN)
        where = open_[left], group[before[left]]
        self.lower[where] = np.minimum(self.lower[where], root)
        for g, (at, members, d) in of.items():
            others = np.where(members[None, :] == number[at][:, None], np.iinfo(np.int64).max, d)
            self.lower[open_[at], g] = np.sqrt(others.min(1)) * (1 - MARGIN)
        self.cluster[open_], self.upper[open_] = number, np.sqrt(best) * (1 + MARGIN)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), width)


STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>"


def _round(centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None):
    """A round's assignment: the first one (no drift) knows nothing yet."""
    groups = int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                n, x = batch.num_rows, _matrix(batch.column(1), centroids.shape[1]).astype(np.int64)
                if drift is None:
                    known = Bounds(x, np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, groups), -np.inf))
                else:
                    known = Bounds(x, np.asarray(batch.column(2), np.int64).copy(), np.asarray(batch.column(3)).copy(), _matrix(batch.column(4), groups).copy())
                    known.moved(drift, group)
                known.assign(centroids, group)
                lower = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * groups), pa.array(known.lower.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known.cluster.astype(np.int32)), pa.array(known.upper), lower], ["vec_id", "v", "cluster", "upper", "lower"])

    return run


def _sums(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, c = _matrix(batch.column(0), width).astype(np.int64), np.asarray(batch.column(1), np.int64)
            np.add.at(total, c, x)
            n += np.bincount(c, minlength=k)
        some = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), sums], ["cluster", "n", "sums"])

    return run


def cluster(kept: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, ...) of ``integers`` rows after the rounds and one more
    assignment, and the centroids of that assignment."""
    store = Store(kept.sparkSession)
    state = store.keep(kept)
    centroids = start(state, k, seed)
    if not len(centroids):
        return state.limit(0).selectExpr("vec_id", "v", "0 as cluster", "0D as upper", "array(0D) as lower"), centroids
    group = grouped(centroids, max(1, len(centroids) // EACH))
    drift = None
    for number in range(rounds + 1):
        state = store.keep(state.mapInArrow(_round(centroids, group, drift), STATE))
        store.drop(store.made - 1)
        if number < rounds:
            parts = state.select("v", "cluster").mapInArrow(_sums(len(centroids), width), "cluster int, n long, sums array<long>")
            summed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width))).alias("sums"))
            moved = centroids.copy()
            for r in summed.collect():  # a row a cluster
                moved[r.cluster] = [int(s) // r.n for s in r.sums]
            drift = np.sqrt(((moved - centroids) ** 2).sum(1)) * (1 + MARGIN)
            centroids = moved
    return state, centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def op13_query(spark, sf_dir: str) -> DataFrame:
    state, centroids = cluster(integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column(2), np.int64)
            d = ((_matrix(batch.column(1), centroids.shape[1]).astype(np.int64) - centroids[c]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    store = Store(spark)
    out = store.keep(state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long") if len(centroids) else state.selectExpr("vec_id", "cluster", "0L as distance"))
    by = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    rows = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in by), digest(centroids[r.cluster])) for r in by]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same rows by plain rounds, for vectors with ids."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x.v) AS v, arg_min(c.c, ({far}, c.c)) AS c, min({far}) AS d FROM kept x, c{i} c GROUP BY vec_id)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({WIDTH})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v)::BIGINT[] AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {WIDTH}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {K}),
{", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (c)
"""


OP13_SQL = _sql()
