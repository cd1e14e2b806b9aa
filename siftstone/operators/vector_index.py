"""A stored vector index: an inverted file with trained centroids.

Vectors are filed by their nearest centroid (a cell; files are partitioned by it), in
segments that upserts and deletes add to (``segments``).  A row is alive while no
later change names its id; ``compact`` rewrites what is alive.

Search looks into the cells whose centroid is at most ``1 + slack`` times as far as
the nearest one.  It is one rule at every size: where vectors form clusters it picks
few cells, where they do not it picks many, so that recall holds (tests measure it on
both).  With ``exact`` the k-th score found so far then opens every further cell whose
radius lets a member reach it, which gives the same rows as ``retrieval.knn``.  Only
opened cells are read: the cells are a partition filter of the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.retrieval import BLOCK, CELL, CHUNK, _Best, _meet, _unit, _vectors, top_k
from siftstone.operators.segments import Segments

#: Most cells (the centroids go to every task), most vectors that they are trained
#: on, and how much farther than the nearest centroid a probed one may be.
CELLS, SAMPLE, SLACK = 4096, 50_000, 0.25
#: Values of a table of rows and cells that a task computes at once, and thus rows of
#: a batch of probes, each with its query's vector.
TABLE = 1 << 16
#: The cell of vectors without a direction: null, zero, or of another length.
NOWHERE = -1
SCHEMA = "id long, embedding array<float>, away double, seq long, cell int"
#: Scores are at 6 places; bounds leave them that much room.
ROOM = 2e-6


def _slices(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``TABLE`` values of a table of ``columns`` for each row."""
    size = max(1, TABLE // max(1, columns))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.segments = spark, path, Segments(spark, path)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Train centroids on at most ``SAMPLE`` of the vectors (least hashes of their
        ids) and file all of them.  ``vectors`` has id and embedding; the index's width is
        that of most vectors in the sample."""
        made = cls(vectors.sparkSession, path)
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        cells = cells or max(1, min(CELLS, round(math.sqrt(rows.count()))))
        sample = rows.where(F.size("embedding") > 0).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
        width = sample.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = width.w if width else 1
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        units = sample.where(F.size("embedding") == width).withColumn("norm", norm).where("norm > 0").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))).alias("features"))
        if units.isEmpty():
            centroids = [[0.0] * width]
        else:
            centroids = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(units).clusterCenters()] if cells > 1 else [[0.0] * width]
        entry = made.segments.begin("base")
        table = made.spark.createDataFrame(list(enumerate(centroids)), "cell int, centroid array<double>")
        made.segments.write(entry, "centroids", table.coalesce(1))
        made._file(entry, rows, np.array(centroids))
        return made

    def _file(self, entry: dict, rows: DataFrame, centroids: np.ndarray) -> None:
        """Write rows under their cells, and what cells hold, and commit."""
        half = (centroids**2).sum(1) / 2

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, len(centroids)):
                x = _unit(_vectors(batch.column(1), centroids.shape[1]))
                cell = (x @ centroids.T - half).argmax(1) if len(x) else np.zeros(0, int)
                away = np.sqrt(((x - centroids[cell]) ** 2).sum(1))
                cell[~x.any(1)] = NOWHERE
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away), pa.array(cell.astype(np.int32))], ["id", "embedding", "away", "cell"])

        # Of rows with one id the greatest stays; rows without an id cannot be found or replaced.
        once = rows.where("id is not null").groupBy("id").agg(F.max("embedding").alias("embedding"))
        filed = once.mapInArrow(assign, "id long, embedding array<float>, away double, cell int").withColumn("seq", F.lit(entry["seq"]).cast("long"))
        self.segments.write(entry, "vectors", filed.hint("rebalance", "cell"), "cell")
        written = self.segments.read("vectors", SCHEMA, [entry])
        self.segments.write(entry, "cells", written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).coalesce(1))
        self.segments.commit(entry)

    def centroids(self) -> np.ndarray:
        base = self.segments.live()[:1]
        return np.array([r.centroid for r in self.segments.read("centroids", "cell int, centroid array<double>", base).orderBy("cell").collect()])

    def cells(self) -> dict[int, tuple[int, float]]:
        """(rows, radius) of each cell that has any; at most ``CELLS`` and one."""
        found = self.segments.read("cells", "cell int, n long, radius double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return {r.cell: (r.n, r.radius) for r in found.collect()}

    def upsert(self, rows: DataFrame) -> None:
        """Add rows (id, embedding), in place of those with the same ids."""
        entry = self.segments.begin("upsert")
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        self.segments.write(entry, "gone", rows.where("id is not null").select("id").distinct().withColumn("until", F.lit(entry["seq"]).cast("long")))
        self._file(entry, rows, self.centroids())

    def delete(self, ids: DataFrame) -> None:
        """Remove the rows with these ids (column id)."""
        entry = self.segments.begin("delete")
        gone = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        self.segments.write(entry, "gone", gone.withColumn("until", F.lit(entry["seq"] + 1).cast("long")))
        self.segments.commit(entry)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that are alive, of some cells or all."""
        entries = self.segments.live()
        rows = self.segments.read("vectors", SCHEMA, entries).drop("segment")
        if cells is not None:
            rows = rows.where(F.col("cell").isin(cells))
        if any("gone" in e["tables"] for e in entries):
            gone = self.segments.read("gone", "id long, until long", entries).groupBy("id").agg(F.max("until").alias("until"))
            rows = rows.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")
        return rows

    def compact(self) -> None:
        """Write what is alive as one base, under the same centroids."""
        entry, centroids = self.segments.begin("base"), self.centroids()
        self.segments.write(entry, "centroids", self.spark.createDataFrame(list(enumerate(centroids.tolist())), "cell int, centroid array<double>").coalesce(1))
        self._file(entry, self.rows().select("id", "embedding"), centroids)

    def _probes(self, asked: DataFrame, centroids: np.ndarray, cells: dict[int, tuple[int, float]], slack: float, reach: bool) -> DataFrame:
        """(qid, embedding, cell): the near cells of each query; with ``reach`` instead
        those beyond whose members may reach the query's score (column)."""
        own = np.array(sorted(c for c in cells if c != NOWHERE), int)
        radius = np.array([cells[c][1] for c in own])
        nowhere = NOWHERE in cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, len(own)):
                q = _unit(_vectors(batch.column(1), centroids.shape[1]))
                far = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ centroids[own].T + (centroids[own] ** 2).sum(1)))
                picked = far <= far.min(1, keepdims=True) * (1 + slack) if len(own) else far.astype(bool)
                some = np.zeros(len(q), bool)
                if reach:
                    least = np.asarray(batch.column(2).fill_null(-2.0))
                    close = np.maximum(0, far - radius - 1e-7)
                    picked = ~picked & ((1 - close**2 / 2 >= least[:, None] - ROOM) | ~q.any(1)[:, None])
                    some = nowhere & (least <= ROOM)
                row, at = np.nonzero(picked)
                row, cell = np.concatenate((row, np.flatnonzero(some))), np.concatenate((own[at], np.full(some.sum(), NOWHERE)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], ["qid", "embedding", "cell"])

        return asked.mapInArrow(run, "qid long, embedding array<float>, cell int")

    def _found(self, probes: DataFrame, queries: int, k: int, cells: dict[int, tuple[int, float]], width: int) -> DataFrame:
        """(qid, id, score): the k best of each query in each task's part of its cells."""
        schema = "qid long, id long, score double"
        opened = sorted(r.cell for r in probes.select("cell").distinct().collect())  # at most CELLS and one
        rows = self.rows(opened)
        if queries <= BLOCK:
            pairs = probes.groupBy("qid").agg(F.first("embedding").alias("embedding"), F.collect_list("cell").alias("cells")).collect()
            ids = np.array([r.qid for r in pairs], np.int64)
            q = _unit(_vectors(pa.array([r.embedding for r in pairs], pa.list_(pa.float32())), width)) if pairs else np.zeros((0, width))
            of: dict[int, list[int]] = {}
            for i, r in enumerate(pairs):
                for c in r.cells:
                    of.setdefault(c, []).append(i)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = _Best(len(ids), k)
                for whole in batches:
                    for at in range(0, whole.num_rows, CHUNK):
                        batch = whole.slice(at, CHUNK)
                        own, x, cell = np.asarray(batch.column(0), np.int64), _unit(_vectors(batch.column(1), width)), np.asarray(batch.column(2))
                        score = np.full((len(ids), len(own)), -np.inf)
                        for c in np.unique(cell):
                            here, those = np.flatnonzero(cell == c), np.array(of[int(c)])
                            score[np.ix_(those, here)] = np.round(q[those] @ x[here].T, 6) + 0.0
                        best.add(score, own)
                yield best.batch(ids)

            return rows.select("id", "embedding", "cell").mapInArrow(run, schema)

        # Many queries: a cell's rows in parts and the queries in blocks, one task for each pair.
        blocks = queries // BLOCK + 1
        parts = self.spark.createDataFrame([(c, -(-cells[c][0] // CELL)) for c in opened], "cell int, parts int")
        left = probes.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "qid", "embedding")
        right = rows.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "embedding")

        def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
            some = ((np.asarray(x.column(3), np.int64), _vectors(x.column(4), width)) for x in b.to_batches(max_chunksize=CHUNK))
            return pa.Table.from_batches([_meet(np.asarray(a["qid"], np.int64), _unit(_vectors(a["embedding"].combine_chunks(), width)), k, True, some)])

        by = ("cell", "part", "block")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)

    def search(self, queries: DataFrame, k: int, slack: float = SLACK, exact: bool = False) -> DataFrame:
        """(qid, id, score, rank) by cosine at 6 places, ties by id.  ``queries`` has qid
        and embedding; one without a direction scores 0 everywhere and is found by ``exact``."""
        centroids, cells = self.centroids(), self.cells()
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<float>").alias("embedding")).where(F.size("embedding") > 0)
        n, width = asked.count(), centroids.shape[1]
        found = self._found(self._probes(asked, centroids, cells, slack, False), n, k, cells, width)
        if exact:
            from siftstone.functions.lineage import kept

            found = kept(top_k(found, k, "score", "id", "qid").drop("rank"))
            full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")
            more = self._probes(asked.join(full, "qid", "left").select("qid", "embedding", "least"), centroids, cells, slack, True)
            found = found.unionByName(self._found(more, n, k, cells, width))
        return top_k(found, k, "score", "id", "qid")
