from __future__ import annotations

import pytest

from siftstone.operators import tool_tables


def test_tools_answer_from_sql(spark):
    tool_tables.register(spark, shout=lambda t: t + "!")
    spark.createDataFrame([(1, "calculator", "2 ^ 5 + 1"), (2, "calculator", "1 / 0"), (3, "word_count", "a b  c"), (4, "none", "x"), (5, None, "x"), (6, "upper", None), (7, "shout", "hey"), (8, "longest_word", "bb aa c")], "id long, t string, a string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM run_tools(TABLE(asked), tool => 't', argument => 'a')")
    assert got.columns == ["id", "t", "a", "success", "output", "error"]
    rows = {r.id: (r.success, r.output, r.error) for r in got.collect()}
    assert rows[1] == (True, "33", None) and rows[3] == (True, "3", None) and rows[6] == (True, "", None) and rows[7] == (True, "hey!", None) and rows[8] == (True, "bb", None)
    assert rows[2][0] is False and "undefined" in rows[2][2] and rows[4] == (False, None, "unknown tool: none") and rows[5] == (False, None, "unknown tool: None")
    other = spark.sql("SELECT count(*) AS n, count_if(success) AS ok FROM run_tools(TABLE(SELECT 'upper' AS which, 'x' AS what, id FROM range(50)), tool => 'which', argument => 'what')").first()
    assert (other.n, other.ok) == (50, 50)


@pytest.mark.parametrize("call, said", [("TABLE(asked_twice), tool => 'nope', argument => 'a'", "no column"), ("TABLE(SELECT 't' AS t, 'a' AS a, 1 AS Output), tool => 't', argument => 'a'", "twice")])
def test_wrong_calls_say_what_is_wrong(spark, call, said):
    tool_tables.register(spark)
    spark.createDataFrame([("x", "y")], "t string, a string").createOrReplaceTempView("asked_twice")
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM run_tools({call})").collect()
