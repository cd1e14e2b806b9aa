from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_sql_belongs_to_registered_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("siftstone", "__spark_entry__.py"):
        src, dst = ROOT / name, tmp_path / name
        shutil.copytree(src, dst, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, dst)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fuse_rrf' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not SMALL.exists(), reason="needs the generated tables")
def test_queries_equal_their_sql(spark):
    """A few of each kind; the driver compares all of them."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert entry.entry(spark).count() == 10
    for name in ("table_aggregate", "fuse_rrf", "time_weighted_topk", "related_within_2", "parent_chain", "rule_rewrite", "dedup_first_match", "upsert_latest"):
        df = queries[name](spark, str(SMALL))
        got = con.execute(sql[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        rows = [tuple(r) for r in got.fetchall()]
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, rows)), name
