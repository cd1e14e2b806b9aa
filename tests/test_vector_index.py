from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.operators import retrieval as r, vector_index
from siftstone.operators.vector_index import VectorIndex


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.astype("float32").tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)


def asked(df, every=20):
    return df.where(f"id % {every} = 0").select(F.col("id").alias("qid"), "embedding")


def rows(df):
    return sorted(tuple(x) for x in df.select("qid", "id", "score", "rank").collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    return rng.standard_normal((30, 48))[rng.integers(0, 30, 1500)] + 0.25 * rng.standard_normal((1500, 48))


def test_changes_equal_a_rebuilt_index_and_exact_search(spark, tmp_path, clustered):
    base = frame(spark, clustered)
    index = VectorIndex.build(base.where("id < 1200"), str(tmp_path / "a"))
    changed = frame(spark, -clustered[100:150], 100)
    odd = spark.createDataFrame([(9000, [0.0] * 48), (9001, None), (9002, [1.0]), (None, [1.0] * 48)], "id long, embedding array<float>")
    index.upsert(base.where("id >= 1200").union(changed).union(odd))
    index.delete(base.where("id % 7 = 3").select("id"))
    index.upsert(frame(spark, clustered[3:4], 3))  # deleted, then back
    now = base.where("id % 7 <> 3 and not id between 100 and 149").union(changed.where("id % 7 <> 3")).union(odd.where("id is not null")).union(frame(spark, clustered[3:4], 3))
    assert sorted(x.id for x in index.rows().collect()) == sorted(x.id for x in now.collect())
    q = asked(base)
    want = rows(r.knn(q, now, 8))
    assert rows(index.search(q, 8, exact=True)) == want
    near = rows(index.search(q, 8))
    index.compact()
    index.segments.vacuum()
    assert [e["kind"] for e in index.segments.log()] == ["base"]
    assert rows(index.search(q, 8)) == near and rows(index.search(q, 8, exact=True)) == want
    again = VectorIndex.build(now, str(tmp_path / "b"))
    assert rows(again.search(q, 8, exact=True)) == want
    assert rows(VectorIndex(spark, str(tmp_path / "a")).search(q, 8)) == near  # from what is stored alone


@pytest.mark.parametrize("kind", ["clustered", "uniform", "wide"])
def test_recall_and_pruning(spark, tmp_path, clustered, kind):
    rng = np.random.default_rng(3)
    x = {"clustered": clustered, "uniform": rng.uniform(-1, 1, (1500, 64)), "wide": rng.standard_normal((20, 384))[rng.integers(0, 20, 800)] + 0.4 * rng.standard_normal((800, 384))}[kind]
    df = frame(spark, x)
    index = VectorIndex.build(df, str(tmp_path / kind))
    q = asked(df)
    exact, near = ({(a, b) for a, b, *_ in rows(f)} for f in (r.knn(q, df, 10), index.search(q, 10)))
    assert len(exact & near) >= 0.9 * len(exact)
    cells = index.cells()
    probes = index._probes(q.select("qid", F.col("embedding").cast("array<float>")), index.centroids(), cells, 0.25, False).count()
    if kind != "uniform":
        assert probes < 0.35 * len(cells) * q.count()
    one = index.rows([1, 2])
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len({x.cell for x in one.select("cell").distinct().collect()}) <= 2


def test_many_queries_take_the_shuffled_way(spark, tmp_path, clustered, monkeypatch):
    from siftstone.operators import vector_index

    df = frame(spark, clustered[:400])
    index = VectorIndex.build(df, str(tmp_path / "m"))
    want = rows(r.knn(asked(df, 3), df, 4))
    monkeypatch.setattr(vector_index, "BLOCK", 30)
    monkeypatch.setattr(vector_index, "CELL", 7)
    assert rows(index.search(asked(df, 3), 4, exact=True)) == want


def test_failed_and_lost_races_are_not_seen(spark, tmp_path, clustered):
    df = frame(spark, clustered[:100])
    index = VectorIndex.build(df, str(tmp_path / "f"), cells=4)
    entry = index.segments.begin("upsert")
    index.segments.write(entry, "gone", df.select("id").withColumn("until", F.lit(99).cast("long")))  # and then it dies
    assert index.rows().count() == 100
    index.delete(df.where("id < 10").select("id"))
    with pytest.raises(RuntimeError, match="another writer"):
        index.segments.commit(entry)
    assert index.rows().count() == 90
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "e"))
    assert empty.search(asked(df), 3, exact=True).count() == 0
    empty.upsert(df)
    assert empty.rows().count() == 100


def test_batches_of_probes_are_bounded(spark, tmp_path, monkeypatch):
    # Every query opens every cell here; the function that pairs them is run by itself.
    monkeypatch.setattr(vector_index, "TABLE", 60)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([[1.0, i / 100] for i in range(100)], pa.list_(pa.float32()))], ["qid", "embedding"])

    class Asked:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    index = vector_index.VectorIndex(spark, str(tmp_path))
    centroids = np.array([[0.0, i / 10] for i in range(20)])
    found = index._probes(Asked(), centroids, {c: (1, 1.0) for c in range(20)}, 1e9, False)
    assert max(b.num_rows for b in found) <= 60
    pairs = [(q, c) for b in found for q, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    assert len(pairs) == 2000 and len(set(pairs)) == 2000
