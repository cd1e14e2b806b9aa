from __future__ import annotations

import zlib

import numpy as np
from conftest import SCHEMA
from pyspark.sql import functions as F
from test_tokens import PIECES

import corpus_pipeline
from siftstone.llm import segment


def test_query_and_last_stage_return_the_sampled_ids(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for out in (segment.op4_query(spark, str(tmp_path)), corpus_pipeline.segment_texts(spark, docs, str(tmp_path))):
        got = segment.decode(out, PIECES).where(F.col("doc_id").isNotNull()).collect()
        assert {r.doc_id for r in got} == set(text)
        for r in got:
            assert len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            assert r.round_trip and r.text == text[r.doc_id].replace(segment.MARK, " ")
