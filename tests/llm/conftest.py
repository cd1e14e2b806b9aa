from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def made_documents(n=60, seed=1):
    """Documents with nulls, empty and long texts, copies, near copies, shared
    passages, repeated rows and ties."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ra", "to", "mi", "sel", "dun", "Ka", "é") for b in ("n", "st", "ver", "lo", "qu", "x")] + ["the", "of", "and", "is"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 150))
        if i % 7 == 3:
            t = f"{text(10)}\n{passage} {text(5)}"
        if i % 11 == 5 and rows:
            t = rows[rng.randrange(len(rows))][1]
        if i % 13 == 6 and rows and rows[-1][1]:
            t = rows[-1][1] + " end"
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t) if t else None))
    rows += [(1000, None, "en", "a", None), (1001, "", "en", "b", 0), (1002, " \n\t ", None, None, 4), (1003, text(4000), "en", "a", None), rows[3], rows[3], (None, text(80), "en", "c", 1), (None, text(90), "de", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
