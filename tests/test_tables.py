from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftstone.functions import text
from siftstone.operators import state, tables
from siftstone.sources import tables as src


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("North", 5, None), ("South", 7, 1), ("north-east", None, 3), ("West", 7, 2)], "region string, q1 long, q2 long")


@pytest.mark.parametrize("op,value,n", [("==", 7, 2), ("!=", 7, 1), (">", 5, 2), (">=", 5, 3), ("<", 7, 1), ("<=", 7, 3)])
def test_comparisons(sales, op, value, n):
    assert tables.TableQuery(sales).filter("q1", op, value).df.count() == n


def test_contains_is_a_case_insensitive_pattern(sales):
    assert tables.TableQuery(sales).filter("region", "contains", "^NORTH").df.count() == 2
    with pytest.raises(ValueError):
        tables.predicate("q1", "~", 1)


def test_aggregates(sales):
    got = {how: tables.TableQuery(sales).aggregate("q1", how).first()[0] for how in ("sum", "mean", "min", "max", "count", "unique")}
    assert got == {"sum": 19, "mean": pytest.approx(19 / 3), "min": 5, "max": 7, "count": 4, "unique": 2}
    with pytest.raises(ValueError):
        tables.aggregate("q1", "median")
    assert tables.TableQuery(sales).rollup("q1", "sum", "region").count() == 5


def test_sort_puts_nulls_last(sales):
    q = tables.TableQuery(sales)
    assert [r.q1 for r in q.sort("q1", True, "region").df.collect()] == [5, 7, 7, None]
    assert [r.q1 for r in q.sort("q1", False, "region").head(3).df.collect()] == [7, 7, 5]
    assert q.select("region").describe() == {"rows": 4, "columns": ["region"], "sample": [{"region": r} for r in ("North", "South", "north-east")]}


def test_cells_and_types(spark):
    cells = [("$1,234.50", "12%", "1e5", "1_000", "x"), (" 3 ", "7", "2", "5", "")]
    df = spark.createDataFrame(cells, "a string, b string, c string, d string, e string")
    out = tables.infer_types(df)
    assert [t for _, t in out.dtypes] == ["double", "bigint", "string", "bigint", "string"]
    assert out.collect()[0][:4] == (1234.5, 12, "1e5", 1000)


def test_chunks_of_rows(spark):
    rows = spark.range(51).select(F.col("id").alias("row_idx"))
    got = sorted(map(tuple, tables.chunk_table(rows).collect()))
    assert got == [(0, 0, 50, 50, 51), (1, 50, 51, 1, 51)]


def test_read_csv_and_json(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,n\n  a   b ,1\nc,\n")
    assert [tuple(r) for r in src.read_any(spark, str(tmp_path / "t.csv")).collect()] == [("a b", "1"), ("c", "")]
    (tmp_path / "t.json").write_text(json.dumps({"meta": 1, "rows": [{"a": 1, "b": "x"}, {"a": 2}]}))
    assert [tuple(r) for r in src.read_json(spark, str(tmp_path / "t.json")).select("a", "b").collect()] == [("1", "x"), ("2", "")]
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": None}]))
    assert [tuple(r) for r in src.read_json(spark, str(tmp_path / "l.json")).collect()] == [("1",), ("",)]
    with pytest.raises(ValueError):
        src.read_any(spark, "x.doc")


def test_json_documents(spark, tmp_path):
    def read(value):
        (tmp_path / "d.json").write_text(value if isinstance(value, str) else json.dumps(value))
        df = src.read_json(spark, str(tmp_path / "d.json"))
        return df.columns, [tuple(r) for r in df.collect()]

    assert read([{"k": [1, 2], "a": "x  y"}]) == (["k", "a"], [("[1,2]", "x y")])  # one object with a list is a row
    assert read({"z": [{"q": 1}], "a": [{"q": 2}]}) == (["q"], [("1",)])  # the first list of the document
    assert read({"n": {"a": [1]}, "rows": [{"b": None, "a": 1.5}, {"a": True, "c": 1}]}) == (["b", "a"], [("", "1.5"), ("", "true")])
    assert read([["a", 1], ["b", None, 3], []]) == (["col_0", "col_1"], [("a", "1"), ("b", ""), ("", "")])
    assert read(" \n[]") == ([], []) and read({"rows": []}) == ([], [])
    for bad in ({"a": 1}, "5"):
        with pytest.raises(ValueError):
            read(bad)


def test_image_sizes(spark, tmp_path):
    from siftstone.sources import files

    made = {"a.png": b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"), "b.gif": b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little"),
            "c.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + bytes(9),
            "d.webp": b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), "e.jpeg": b"broken", "f.txt": b"no image"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.media_type, r.width, r.height) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("image/png", 640, 480), "b.gif": ("image/gif", 7, 9), "c.jpg": ("image/jpeg", 40, 30), "d.webp": ("image/webp", 100, 50), "e.jpeg": ("image/jpeg", None, None)}


def test_source_trees_without_globs(spark, tmp_path):
    from siftstone.sources import files

    for name in ("a.py", "test_b.py", "pkg/c.py", "pkg/gen/d.py", "venv/e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    got = files.read_sources(spark, str(tmp_path), globs=("test_*", "*/gen/*"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.py", "c.py"]


HTML = """<p>before</p><table><caption> C </caption><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1</td><td> 2  3 </td></tr></table>
<table><tr><th>x</th></tr><tr><td>5</td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table><script>no</script><p>after</p>"""


def test_html_tables_without_body_keep_the_head_out_of_the_data():
    got = src.html_tables(HTML)
    assert got[0] == {"table_index": 0, "caption": "C", "headers": ["a", "b"], "rows": [["1", "2 3"]]}
    assert got[1]["headers"] == ["x"] and ["5"] in got[1]["rows"] and got[2]["rows"] == [["in"]]
    assert src.visible_text(HTML) == "before after"
    assert src.html_tables(None) == [] and src.html_tables("<table>") == []


def test_markdown_tables(spark):
    md = "text\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n| lone |\nend\n| p |\n| q |"
    got = src.markdown_tables(md)
    assert [(t["headers"], t["rows"]) for t in got] == [(["a", "b"], [["1", "2"]]), (["p"], [["q"]])]
    df = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 |\n| 1 | 2 | 3 |")], "id long, md string")
    cells = src.table_cells(src.extract_tables(df, "id", "md", src.markdown_tables)).collect()
    assert [(c.row_idx, c.col, c.value) for c in cells] == [(0, "a", "1"), (0, "b", ""), (1, "a", "1"), (1, "b", "2")]


def test_latest_delete_retain(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2)], "id long, v string, at int")
    assert sorted(map(tuple, state.latest(rows, ["id"], ["at"]).collect())) == [(1, "b", 3), (2, "c", 2)]
    new = spark.createDataFrame([(2, "d", 9)], rows.schema)
    assert sorted(map(tuple, state.upsert(rows, new, ["id"], ["at"]).collect())) == [(1, "b", 3), (2, "d", 9)]
    assert {r.id for r in state.delete(rows, rows.where("v = 'c'").select("id"), "id").collect()} == {1}


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.squeeze(F.lit("  a \t b "))) == "a b" and get(text.squeeze(F.lit(None).cast("string"))) == ""
    assert get(text.json_object(F.lit('so {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}' and get(text.json_object(F.lit("none"))) is None
    assert get(text.json_array(F.lit("x [1, 2] y"))) == "[1, 2]"
    reply = F.lit("words\nQUALITY: Good \nGAPS:\n")
    assert get(text.protocol_value(reply, "QUALITY")) == "Good" and get(text.protocol_value(reply, "GAPS")) == "" and get(text.protocol_value(reply, "SCORE")) is None
    assert get(text.one_of(F.lit("POOR"), ("poor", "good"), "good")) == "poor" and get(text.one_of(F.lit("?"), ("poor", "good"), "good")) == "good"
    assert get(text.pad_row(F.array(F.lit("a")), 3)) == ["a", "", ""]
