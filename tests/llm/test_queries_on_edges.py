"""Every query on empty tables, and on very long texts and unbroken words."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SCHEMA, words
from test_dedup import linked, print_of, removed
from test_text import counts, jaccard, spots
from test_tokens import BPE

import corpus_pipeline
from siftstone.llm import queries

EDGES = {"op2_substring_dedup", "op4_segment_sampling", "op5_token_file", "op6_spotsigs", "op7_simhash_dedup", "op8_source_mixing", "op9_token_counts", "op10_quality_rules", "op12_minimax_sharding"}


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [])
    for name, query in queries.queries().items():
        assert query(spark, sf).count() == (1 if name == "op1_chat_format" else 0), name
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ra", "to", "mi", "sel", "the", "Ka", "é") for b in ("n", "st", "ver", "", "qu")]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    letters = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    book = text(40_000)
    return [(1, book, "en", "a", 1), (2, text(30) + " " + book[:90_000] + "\n" + text(50), "en", "a", 1), (3, letters, "en", "b", 1), (4, f"x {letters} y", None, "b", 1), (5, "日本語" * 9_000, "de", None, 1), (6, "\n" * 5_000 + text(60), "de", None, 1)]


def test_long_texts(spark, tmp_path, long_rows):
    from tokenizers import Tokenizer

    sf = tables(spark, tmp_path, long_rows)
    got = {name: {r.doc_id: r for r in query(spark, sf).collect()} for name, query in queries.queries().items() if name in EDGES}
    library = Tokenizer.from_file(BPE)
    text = {r[0]: r[1] for r in long_rows}
    cut = {r[0]: r for r in removed(long_rows, 13)}
    groups = linked([print_of(t) for t in text.values()])
    for k, (i, t) in enumerate(text.items()):
        tokens = library.encode(t, add_special_tokens=False).ids
        row = got["op2_substring_dedup"][i]
        assert (row.n_words, row.n_removed, row.kept_sha256) == (cut[i][1], cut[i][2], hashlib.sha256(cut[i][3].encode()).hexdigest())
        assert got["op4_segment_sampling"][i].round_trip
        row = got["op5_token_file"][i]
        assert (row.n_tokens, row.ids_crc32) == (len(tokens) + 1, zlib.crc32(np.array([*tokens, 2], "<u4").tobytes()))
        row, after = got["op6_spotsigs"][i], text[i % len(text) + 1]
        half = len(t) // 2
        assert row.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert row.near_next == pytest.approx(jaccard(spots(t), spots(after)))
        assert got["op7_simhash_dedup"][i].fingerprint == f"{print_of(t):016x}"
        assert got["op7_simhash_dedup"][i].component_id == min(j for j, g in zip(text, groups) if g == groups[k])
        assert got["op8_source_mixing"][i].size == len(words(t))
        row = got["op9_token_counts"][i]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (len(tokens), len(t.encode()), len(tokens) > 2048)
        row = got["op12_minimax_sharding"][i]
        assert (row.size, row.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        row = got["op10_quality_rules"][i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == counts(t)
