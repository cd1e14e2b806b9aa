"""Table readers: delimited text, JSON, HTML, Markdown, spreadsheets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import squeeze

TABLE_SCHEMA = "table_index int, caption string, headers array<string>, rows array<array<string>>"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text, white space squeezed; the first row names them."""
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, mode="PERMISSIVE", encoding="UTF-8")
    return raw.select(*(squeeze(F.col(f"`{c}`")).alias(c) for c in raw.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document that is an array of rows, or an object whose first array, in
    the document's order, holds them.  Rows are objects, with the first one's
    keys as columns, or arrays, with as many columns ``col_0``, ... as the first.
    Values are text, white space squeezed; missing ones are empty.  An object
    without an array is an error, an empty array a table without columns."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\x{FEFF}\s]+", "").alias("v"))
    members = F.from_json("v", "map<string,string>")
    keys = F.filter(F.json_object_keys("v"), lambda k: F.element_at(members, k).startswith("["))
    held = whole.select(F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.element_at(members, F.get(keys, F.lit(0)))).alias("v"))
    rows = held.select(F.explode_outer(F.from_json("v", "array<string>")).alias("x"), F.col("v").isNull().alias("none"))
    first = rows.select("x", "none", F.json_object_keys("x").alias("keys"), F.size(F.from_json("x", "array<string>")).alias("n")).first()
    if first is None or first.none:
        raise ValueError("the document holds no array")
    if first.x is None:
        return spark.createDataFrame([], "").limit(0)
    if first.x.lstrip().startswith("["):
        cells = F.from_json("x", "array<string>")
        return rows.select(*(squeeze(F.get(cells, F.lit(i))).alias(f"col_{i}") for i in range(first.n)))
    if first["keys"] is None:
        return rows.select(squeeze(F.col("x")).alias("col_0"))
    cells = F.from_json("x", "map<string,string>")
    return rows.select(*(squeeze(F.element_at(cells, k)).alias(k) for k in first["keys"]))


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Fields of a JSON text column beside the other columns."""
    parsed = df.withColumn("_json", F.from_json(column, schema))
    return parsed.select(*df.columns, "_json.*")


class _Tables(HTMLParser):
    """Collects the tables of a page; nested ones count on their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"caption": None, "head": [], "rows": [], "row": None, "cell": None, "in_head": False, "in_caption": False, "order": len(self.done) + len(self.open)})
        if not self.open:
            return
        t = self.open[-1]
        if tag == "thead":
            t["in_head"] = True
        elif tag == "caption":
            t["caption"], t["in_caption"] = "", True
        elif tag == "tr":
            self._end_row(t)
            t["row"] = []
        elif tag in ("td", "th"):
            self._end_cell(t)
            if t["row"] is None:
                t["row"] = []
            t["cell"] = [tag, ""]

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th"):
            self._end_cell(t)
        elif tag == "tr":
            self._end_row(t)
        elif tag == "thead":
            self._end_row(t)
            t["in_head"] = False
        elif tag == "caption":
            t["in_caption"] = False
        elif tag == "table":
            self._end_row(t)
            self.done.append(self.open.pop())

    def handle_data(self, data):
        for t in self.open:
            if t["in_caption"]:
                t["caption"] += data
            if t["cell"] is not None:
                t["cell"][1] += data

    def close(self):
        super().close()
        while self.open:
            self._end_row(self.open[-1])
            self.done.append(self.open.pop())

    @staticmethod
    def _end_cell(t):
        if t["cell"] is not None:
            t["row"].append((t["cell"][0], " ".join(t["cell"][1].split())))
            t["cell"] = None

    def _end_row(self, t):
        self._end_cell(t)
        if t["row"]:
            (t["head"] if t["in_head"] else t["rows"]).append(t["row"])
        t["row"] = None


def html_tables(html: str | None) -> list[dict]:
    """Tables of a page.  Headers: the head section's cells, else a first row
    of header cells only; head rows are never data."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for t in sorted(parser.done, key=lambda t: t["order"]):
        headers = [c for r in t["head"] for _, c in r]
        rows = []
        for r in t["rows"]:
            if not headers and all(kind == "th" for kind, _ in r):
                headers = [c for _, c in r]
            else:
                rows.append([c for _, c in r])
        if headers or rows:
            out.append({"table_index": len(out), "caption": None if t["caption"] is None else t["caption"].strip(), "headers": headers, "rows": rows})
    return out


class _Visible(HTMLParser):
    _SKIP = ("script", "style", "table", "head", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self._SKIP

    def handle_endtag(self, tag):
        self.depth -= tag in self._SKIP and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(" ".join(data.split()))


def visible_text(html: str | None) -> str:
    """A page's text without tables, scripts and styles."""
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    return " ".join(parser.parts)


_RULE = re.compile(r"[-:]+")


def markdown_tables(text: str | None) -> list[dict]:
    """Blocks of at least two lines between pipes; a second line of dashes and
    colons is the separator."""
    out, block = [], []
    for line in [*(text or "").split("\n"), ""]:
        if len(line) > 2 and line.startswith("|") and line.endswith("|"):
            block.append([" ".join(c.split()) for c in line.strip("|").split("|")])
            continue
        if len(block) >= 2:
            skip = 2 if all(_RULE.fullmatch(c) for c in block[1]) else 1
            out.append({"table_index": len(out), "caption": None, "headers": block[0], "rows": block[skip:]})
        block = []
    return out


def extract_tables(docs: DataFrame, id_col: str, text_col: str, kind: Callable[[str | None], list[dict]] = html_tables) -> DataFrame:
    """(id, table_index, caption, headers, rows) of every document's tables."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(f"id long, {TABLE_SCHEMA}")
    arrow = pa.schema([("id", pa.int64()), ("table_index", pa.int32()), ("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"id": i, **t} for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in kind(text)]
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, schema)


def table_cells(extracted: DataFrame) -> DataFrame:
    """Long form: (id, table_index, row_idx, col_idx, col, value), rows fitted
    to the header's width, columns without a name called col_i."""
    width = F.greatest(F.size("headers"), F.lit(0))
    names = F.when(width > 0, F.col("headers")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(F.transform("rows", F.size)), F.lit(1))), lambda i: F.concat(F.lit("col_"), i - 1)))
    named = extracted.withColumn("names", names)
    fitted = named.select("id", "table_index", "names", F.posexplode("rows").alias("row_idx", "row"))
    fitted = fitted.withColumn("row", F.slice(F.concat("row", F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size("names")))
    cells = fitted.select("id", "table_index", "row_idx", "names", F.posexplode("row").alias("col_idx", "value"))
    return cells.select("id", "table_index", "row_idx", "col_idx", F.get("names", F.col("col_idx")).alias("col"), "value")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Each sheet a table (needs openpyxl, which is optional)."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("spreadsheets need openpyxl") from e

    arrow = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import openpyxl

        for batch in batches:
            out = []
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for sheet in openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True):
                    rows = [["" if c is None else " ".join(str(c).split()) for c in r] for r in sheet.iter_rows(values_only=True) if any(c is not None for c in r)]
                    if rows:
                        out.append({"path": where, "sheet": sheet.title, "headers": rows[0], "rows": rows[1:]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sheet string, headers array<string>, rows array<array<string>>")


#: Readers by file suffix.
READERS = {".csv": read_csv, ".tsv": lambda s, p: read_csv(s, p, "\t"), ".json": read_json, ".xlsx": read_excel, ".xls": read_excel}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix in (".html", ".htm", ".md"):
        texts = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("id"), "value")
        return extract_tables(texts, "id", "value", markdown_tables if suffix == ".md" else html_tables)
    if suffix not in READERS:
        raise ValueError(f"unsupported file type: {suffix}")
    return READERS[suffix](spark, path)
