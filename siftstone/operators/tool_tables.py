"""Tools as table functions, called from SQL.

``run_tools(TABLE(rows), tool => 'column', argument => 'column')`` gives each row
with success, output and error: its tool column names the tool, its argument column is what
the tool is given.  The result's schema follows the table's.  A tool that is not in the
catalog, and one that fails, give error rows; a null argument is an empty one.  Rows keep the
tasks that they are in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siftstone.operators.tools import _calculate

MADE = (StructField("success", BooleanType()), StructField("output", StringType()), StructField("error", StringType()))


def _words(text: str) -> int:
    return len(text.split())


def _longest(text: str) -> str:
    return max(text.split(), key=lambda w: (len(w), w), default="")


#: The catalog that comes with the engine; others are registered functions of one text.
CATALOG: dict[str, Callable[[str], object]] = {"calculator": _calculate, "word_count": _words, "longest_word": _longest, "upper": str.upper}


def table_function(catalog: dict[str, Callable[[str], object]]):
    """The table function over a catalog."""

    class RunTools:
        @staticmethod
        def analyze(rows: AnalyzeArgument, tool: AnalyzeArgument, argument: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: TABLE(...)")
            names = [f.name for f in rows.dataType.fields]
            for given in (tool, argument):
                if given.value not in names:
                    raise ValueError(f"no column {given.value!r} in the table; it has {', '.join(names)}")
            if clash := {n.lower() for n in names} & {f.name for f in MADE}:
                raise ValueError(f"columns {', '.join(sorted(clash))} would be there twice")
            return AnalyzeResult(StructType([*rows.dataType.fields, *MADE]))

        def eval(self, rows, tool: str, argument: str):
            run, text = catalog.get(rows[tool]), rows[argument]
            if run is None:
                yield (*rows, False, None, f"unknown tool: {rows[tool]}")
                return
            try:
                yield (*rows, True, str(run("" if text is None else str(text))), None)
            except Exception as e:  # the error is the result
                yield (*rows, False, None, f"{type(e).__name__}: {e}")

    return udtf(RunTools)


def register(spark: SparkSession, name: str = "run_tools", **more: Callable[[str], object]) -> None:
    """Make the catalog, and further tools by name, callable from SQL."""
    spark.udtf.register(name, table_function(CATALOG | more))
