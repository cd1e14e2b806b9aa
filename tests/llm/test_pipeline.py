from __future__ import annotations

from collections import Counter

from conftest import SCHEMA, words
from pyspark.sql import functions as F
from test_dedup import removed
from test_nearcopies import kept

import corpus_pipeline
from siftstone.llm import mixing, quality, queries


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_follow_brute_force(spark, tmp_path, rows):
    unique = [r for r in {repr(r[0]): r for r in rows if r[0] is not None}.values()]
    unique += [(20_000 + i, r[1] + " more words", r[2], r[3], r[4]) for i, r in enumerate(unique) if r[1] and len(words(r[1])) > 100]
    spark.createDataFrame(unique, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)

    one = corpus_pipeline.quality_rules(spark, docs, sf)
    expected = [r for r in unique if not base_failed(r[1])]
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(expected, key=repr) and one.columns == docs.columns

    two = corpus_pipeline.near_duplicates(spark, one, sf)
    stay = set(kept(expected))  # five words, Jaccard 0.8
    expected = [r for r in expected if r[0] in stay]
    assert sorted(map(tuple, two.collect()), key=repr) == sorted(expected, key=repr) and two.columns == docs.columns

    three = corpus_pipeline.repeated_passages(spark, two, sf)
    cut = {r[0]: r for r in removed(expected, 13)}
    text = {r[0]: (r[1] if not cut[r[0]][2] else cut[r[0]][3]) for r in expected if not cut[r[0]][2] or cut[r[0]][2] < cut[r[0]][1]}
    assert {r.doc_id: r.text for r in three.collect()} == text and three.columns == docs.columns

    four = corpus_pipeline.mix_sources(spark, three, sf)
    copies = Counter(r.doc_id for r in four.collect())
    assert set(copies.values()) <= {1, 2, 3} and four.columns == docs.columns
    total = sum(len(words(t)) for t in text.values())
    assert abs(sum(len(words(text[d])) * n for d, n in copies.items()) - total) <= 4 * max(len(words(t)) for t in text.values())

    four.write.parquet(str(tmp_path / "mixed"))
    order = [r.doc_id for r in mixing.mix(three).collect()]
    last = corpus_pipeline.run(spark, sf).cache()
    ranks = {r.train_rank: r.doc_id for r in last.collect()}
    assert [ranks[k] for k in range(len(ranks))] == order
    twice = [d for d, n in copies.items() if n > 1 and len(words(text[d])) > 20]
    samples = last.where(F.col("doc_id").isin(twice) & (F.col("sample") == 0)).groupBy("doc_id").agg(F.countDistinct("ids").alias("n")).collect()
    assert twice and all(r.n == copies[r.doc_id] for r in samples)
    again = corpus_pipeline.segment_texts(spark, spark.read.parquet(str(tmp_path / "mixed")), sf).select("doc_id", "train_rank", "sample", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, last.select(again.columns).collect()))
    assert last.where("not round_trip").count() == 0
    assert {r.doc_id: r.n for r in last.where("sample = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == dict(copies)


def base_failed(text):
    from test_text import counts

    return counts(text)[5]


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "sentencepiece_sampling"]
    assert quality.MEASURES


def test_stages_take_clashing_names_and_empty_tables(spark, tmp_path, rows):
    more = "n_words int, KEPT int, kept_text string, n_removed int, position double, size int, rank int, row_key int, measured int, found int"
    made = [(*r, 1, 2, "x", 3, 4.0, 5, 6, 7, 8, 9) for r in rows]
    for name, some in (("full", made), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(some, f"{SCHEMA}, {more}").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, sf).cache()
            assert docs.columns == columns
            assert all(tuple(r)[5:] == (1, 2, "x", 3, 4.0, 5, 6, 7, 8, 9) for r in docs.collect())
        assert (docs.count() > 0) == bool(some)
        assert (corpus_pipeline.segment_texts(spark, docs, sf).count() > 0) == bool(some)
