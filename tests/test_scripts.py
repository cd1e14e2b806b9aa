from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.text import shingle_words
from siftstone.operators import dedup

RUSSIAN = " ".join(f"слово{i} текста" for i in range(40))
GREEK = " ".join(f"λέξη{i} κειμένου" for i in range(40))
HINDI = " ".join(f"शब्द{i} हिन्दी" for i in range(40))


def test_near_copies_in_other_scripts(spark):
    rows = [(1, RUSSIAN), (2, RUSSIAN + " конец"), (3, GREEK), (4, GREEK + " τέλος"), (5, HINDI), (6, HINDI + " अन्त")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.id, r.duplicate_of) for r in dedup.first_match(docs).collect()}
    assert found == {(2, 1), (4, 3), (6, 5)}
    assert dedup.signatures(docs).count() == 6


def test_contamination_in_another_script(spark):
    docs = spark.createDataFrame([(1, "Начало: " + RUSSIAN), (2, GREEK)], "doc_id long, text string")
    items = spark.createDataFrame([(9, RUSSIAN)], "item_id long, text string")
    assert [(r.item_id, r.id, r.share) for r in dedup.contamination(docs, items).collect()] == [(9, 1, 1.0)]


def test_words_keep_letters_marks_and_digits(spark):
    text = "Tiếng Việt, Привет! 東京\u3000大阪 e\u0301te\u0301 a_b"
    got = spark.range(1).select(shingle_words(F.lit(text)).alias("w")).first().w
    assert got == ["tiếng", "việt", "привет", "東京", "大阪", "e\u0301te\u0301", "a_b"]


def test_sources_of_one_file_are_parsed_by_all_cores(spark, tmp_path):
    """A small table of sources is one task to read, but much to parse."""
    from siftstone.operators import code, scripts

    spark.createDataFrame([(f"m{i}.py", "def f():\n    pass\n") for i in range(40)], "path string, source string").coalesce(1).write.parquet(f"{tmp_path}/files")
    files, cores = spark.read.parquet(f"{tmp_path}/files"), spark.sparkContext.defaultParallelism
    assert files.rdd.getNumPartitions() == 1
    assert [parse(files).rdd.getNumPartitions() for parse in (code.parse_units, code.parse_imports, scripts.parse_scripts)] == [cores] * 3
