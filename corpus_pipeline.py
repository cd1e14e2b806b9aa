"""From raw documents to sampled segmentations, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.  Null,
empty and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import mixing, nearcopies, quality, segment, substring
from siftstone.llm.common import Store, col, table
from siftstone.llm.tokens import public_path


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that clash with nothing an operator adds, and the
    new name of each."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a base rule or a risk-controlled cutoff rejects."""
    plain, names = _plain(docs)
    judged = quality.apply_rules(plain, table(spark, sf_dir, "labels"), names["doc_id"], names["text"], names["lang"])
    return _back(judged.where("kept"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by Jaccard 0.8 or more of their
    five-word shingles: SimHash anchors, then bands, confirmed on whole sets."""
    return nearcopies.keep_one(docs).select(*(col(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id holds too.  Documents of
    which nothing is left go; untouched ones keep their text as it is."""
    plain, names = _plain(docs)
    cut = substring.remove_duplicate_spans(plain, names["doc_id"], names["text"])
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in names:
        changed["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    out = cut.select(*(F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(n)).alias(n) if c in changed else F.col(n) for c, n in names.items()))
    return _back(out, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, in training order,
    which the written table keeps (``mixing.read_order``)."""
    return mixing.mix(docs, with_position=False)


def segment_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every copy: id, the copy's rank in the training
    order (which seeds it, so that copies of a document differ), sample, scores
    and piece ids."""
    ranked = mixing.read_order(docs.select("doc_id", "text"), "train_rank")
    return segment.sample_segmentations(ranked, public_path("piece_bpe_32k.model"), digest=True, seed_col="train_rank")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece_sampling", segment_texts),
]

#: Stages 2, 3 and 5 have no SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs, store = table(spark, sf_dir, "documents"), Store(spark)
    for _, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
