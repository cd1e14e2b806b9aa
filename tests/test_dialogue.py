from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import calculator, routing
from siftstone.operators import chunking, code, compose, conversation, hierarchy, research, tools


def asked(spark, column, *questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i long, q string")
    return [r.x for r in df.select("i", column(F.col("q")).alias("x")).orderBy("i").collect()]


def test_routes(spark):
    got = asked(spark, routing.route, "What is 5 + 3?", "what time is it now", "Write a code sample", "latest news", "according to the report", "hello there")
    assert [x and x.route for x in got] == ["tool_use", "tool_use", "tool_use", "web_search", "retrieval", None]
    assert [x and x.tool for x in got] == ["calculator", "datetime", "code_executor", "web_search", None, None]
    without = asked(spark, lambda q: routing.route(q, tools=("web_search",)), "calculate it today")
    assert without[0].route == "web_search"


def test_intents_and_classes(spark):
    assert [x.intent for x in asked(spark, routing.intent, "how to create it", "compare a vs b", "hm")] == ["procedural", "comparative", "unknown"]
    assert asked(spark, routing.query_class, "what is linked", "describe it", "which one") == ["cross-reference", "broad", "specific"]


def test_rewriting(spark):
    assert asked(spark, routing.needs_rewriting, "What does it do", "is it? really so", "tell me more", "Why?", "Explain quantum computing to a child", "use it?") == [True, False, True, True, False, True]
    cases = [("Tell me more", ["a"], ["e1", "e2"], "Tell me more about e2"), ("What of the second?", ["a"], [], None), ("What of the Second?", ["a", "b"], [], "what of 'b'?"), ("the last one", ["a", "b"], [], "'b' one"), ("the first", [], ["e"], "'e'"), ("plain", ["a"], ["e"], None), ("tell me more", [], [], None)]
    df = spark.createDataFrame(cases, "q string, c array<string>, e array<string>, w string")
    for r in df.select("w", routing.rewrite(F.col("q"), F.col("c"), F.col("e")).alias("x")).collect():
        assert r.x == r.w


def test_tool_arguments(spark):
    rows = [("calculator", "what is 2 + 3", "2 + 3"), ("calculator", "nothing", "nothing"), ("datetime", "what day is it", "weekday"), ("datetime", "date please", "date"), ("web_search", "x y", "x y")]
    for r in spark.createDataFrame(rows, "t string, q string, w string").select("w", routing.tool_argument(F.col("t"), F.col("q")).alias("x")).collect():
        assert r.x == r.w


@pytest.mark.parametrize("text,value", [("25 * 4", 100), ("2^10", 1024), ("2^3^2", 512), ("-2^2", -4), ("sqrt(16)", 4), ("5 % 3", 2), ("-5 % 3", 1), ("(1+2)*3 - 4/2", 7), ("pow(2, 3) + log10(100)", 10), ("2 * pi", 6.283185307179586), ("1/0", None), ("abs(-3)+exp(0)", 4)])
def test_calculator(spark, text, value):
    assert calculator.evaluate(text) == (None if value is None else pytest.approx(value))
    assert spark.range(1).select(calculator.to_column(text).alias("x")).first().x == (None if value is None else pytest.approx(value))


@pytest.mark.parametrize("text", ["__import__('os')", "a + 1", "2 +", "(1", "1 2", "open(1)", "x.y", "sqrt()", ""])
def test_calculator_rejects(text):
    with pytest.raises(ValueError):
        calculator.parse(text)


def test_registry(spark):
    r = tools.standard()
    r.register(tools.Tool("upper", "upper case", tools.from_function(str.upper)))
    df = spark.createDataFrame([("2+2",), ("1/0",)], "q string")
    got = df.select(r.execute("calculator", F.col("q")).alias("a"), r.execute("upper", F.col("q")).alias("b"), r.execute("gone", F.col("q")).alias("c")).collect()
    assert got[0].a.output == "4" and got[0].a.success and not got[1].a.success and "undefined" in got[1].a.error
    assert got[0].b.output == "2+2" and got[0].c.error == "unknown tool: gone"
    assert [t.name for t in r.by_category("calculation")] == ["calculator"] and len(r.definitions()) == 3
    r.unregister("upper")
    assert r.get("upper") is None and r.names() == ["calculator", "datetime"]
    with pytest.raises(ValueError):
        tools.provider("none")


def test_providers_and_vectors(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "i long, prompt string")
    got = {r.i: r.answer for r in tools.generate(df, tools.provider("offline")).collect()}
    assert got[1].startswith("answer-") and got[2] is None
    v = tools.digest_embedding("x")
    assert len(v) == 384 and v[:8] == v[8:16] and all(-1 <= x <= 1 for x in v)
    vertices, edges = tools.extract_entities(df.withColumnRenamed("i", "doc_id"), lambda t: [(w, "word") for w in t.split()] * 20, text_col="prompt")
    assert vertices.count() == 10 and edges.first().target == "1_entity_0"


def test_chunks():
    assert chunking.by_chars("") == [] and chunking.by_chars("short") == ["short"]
    text = "A sentence here. " * 100
    pieces = chunking.by_chars(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces) and pieces[0].endswith(".")
    assert chunking.by_words("aa bb cc", 5) == ["aa bb", "cc"] and chunking.by_words("x" * 50, 5) == ["x" * 50]
    assert chunking.by_paragraphs([], 5) == [] and chunking.by_paragraphs(["", "a" * 9, "b"], 4, 0) == ["", "a" * 9, "b"]
    assert chunking.by_paragraphs(["a" * 9, "b" * 9, "c"], 3, 2) == ["a" * 9, "aa\n\n" + "b" * 9, "bb\n\nc"]
    assert chunking.by_paragraphs(["a" * 6, "b" * 6, "c"], 10, 2) == ["a" * 6, "aa\n\n" + "b" * 6 + "\n\nc"]
    words = [{"text": t, "x0": x, "top": y, "x1": x + 5, "bottom": y + 10} for t, x, y in (("b", 10, 1), ("a", 0, 0), ("c", 0, 20), ("d", 0, 90))]
    lines = chunking.lines_of_words(words)
    assert [x["text"] for x in lines] == ["a b", "c", "d"] and chunking.paragraphs_of_lines(lines) == ["a b c", "d"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_windows_end_and_cover_the_text(text, size, overlap):
    pieces = chunking.by_chars(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    rest = text
    for p in pieces:
        assert p in text
    assert sum(len(p.replace(" ", "").replace("\n", "")) for p in pieces) >= len(rest.replace(" ", "").replace("\n", ""))


MD = "# 1 Intro\nA paragraph that is certainly longer than fifty characters, see Section 2.1 and [3].\nshort\n## 1.1 Part\n" + "x" * 60 + "\n# 2 Next\n## 2.1 Deep\n" + "y" * 70


def test_sections_and_references(spark):
    nodes = hierarchy.markdown_tree(spark.createDataFrame([(7, MD)], "doc_id long, text string")).cache()
    by = {r.id: r for r in nodes.collect()}
    assert [by[k].title for k in ("d7.s0", "d7.s3", "d7.s5", "d7.s6")] == ["Intro", "Part", "Next", "Deep"]
    assert [by[k].parent_id for k in ("d7.s0", "d7.s3", "d7.s6", "d7.p1", "d7.p4")] == ["d7", "d7.s0", "d7.s5", "d7.s0", "d7.s3"] and "d7.p2" not in by
    refs = {r.text: r for r in hierarchy.references(nodes).collect()}
    assert refs["Section 2.1"].target_id == "d7.s6" and refs["Section 2.1"].resolved and not refs["[3]"].resolved
    hits = spark.createDataFrame([("d7.p1", 0.9)], "id string, score double")
    assert {r.id: r.score for r in hierarchy.with_references(hits, hierarchy.references(nodes), nodes).collect()} == {"d7.p1": 0.9, "d7.s6": 0.5}
    chain = {r.id: r.path for r in hierarchy.parent_chain(nodes, nodes.where("id = 'd7.p4'")).collect()}
    assert chain == {"d7.p4": ["d7", "d7.s0", "d7.s3"]}
    assert hierarchy.subtree(nodes, nodes.where("id = 'd7.s0'")).count() == 4


def test_two_stage_retrieval(spark):
    summaries = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.49)], "document_id long, score double")
    hits = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.8), ("c", 3, 0.99)], "id string, document_id long, score double")
    assert [r.id for r in hierarchy.retrieve(hits, summaries).collect()] == ["b", "a"]
    only = spark.createDataFrame([(1,)], "document_id long")
    assert [r.id for r in hierarchy.retrieve(hits, summaries, targets=only).collect()] == ["a"]


def test_memory(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(6)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in conversation.last_turns(turns, 2).orderBy("turn").collect()] == [4, 5]
    assert conversation.history(turns, 2).where("turn = 3").first().history == "assistant: t1\nuser: t2"
    assert [r.turn for r in conversation.every(turns, 4).collect()] == [3]
    assert conversation.recent(turns, "text", 2, "x").where("turn = 4").first().x == ["t2", "t3"]
    log = spark.createDataFrame([(1, "k", "old", 1), (1, "k", "new", 2)], "user_id long, key string, value string, at int")
    prefs = conversation.preferences(log)
    assert prefs.first().value == "new"
    facts = spark.createDataFrame([(1, f"f{i}", i) for i in range(7)] + [(2, "g", 1)], "user_id long, fact string, at int")
    docs = spark.createDataFrame([(1, "T", 1)], "user_id long, title string, at int")
    got = {r.user_id: r.context for r in conversation.memory_context(prefs, facts, docs).collect()}
    assert got == {1: "Preferences: k=new\nFacts: f6; f5; f4; f3; f2\nDocuments: T", 2: "Facts: g"}


def test_sessions_persist(spark, tmp_path):
    turns = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "user_id long, session_id long, text string")
    conversation.save_sessions(turns, str(tmp_path / "s"))
    assert conversation.load_sessions(spark, str(tmp_path / "s"), "session_id long, text string, user_id long", 2).first().text == "b"


def test_python_units(spark):
    source = "import os\nfrom a import b as c\nX = 1\nclass A(Base):\n    '''doc'''\n    @property\n    def p(self): return [x for x in f() if x and y or z]\n    async def m(self, a: int = 1, *args, k=2, **kw) -> str:\n        try:\n            pass\n        except E:\n            pass\ndef _g(x): return f(x)\ndef test_f(): f()\ndef f(): pass\n"
    units = {u["id"]: u for u in code.units_of("m.py", source)}
    assert set(units) == {"m.py::X", "m.py::A", "m.py::A.p", "m.py::A.m", "m.py::_g", "m.py::test_f", "m.py::f"}
    assert units["m.py::A.p"]["type"] == "property" and units["m.py::A.p"]["complexity"] == 4
    assert units["m.py::A.m"]["signature"] == "async def m(self, a: int = ..., *args, k = ..., **kw) -> str" and units["m.py::A.m"]["complexity"] == 2
    assert units["m.py::A"]["bases"] == ["Base"] and units["m.py::_g"]["is_private"] and units["m.py::test_f"]["is_test"]
    assert code.units_of("x", "def (") == [] and [i["module"] for i in code.imports_of("m.py", source)] == ["os", "a"]
    df = code.parse_units(spark.createDataFrame([("m.py", source)], "path string, source string"))
    edges = {(r.source, r.target, r.type) for r in code.code_edges(df).collect()}
    assert ("m.py::_g", "m.py::f", "calls") in edges and ("m.py::A", "m.py::A.p", "contains") in edges and ("m.py::test_f", "m.py::f", "tests") in edges
    assert code.find_symbol(df, "f").count() == 1 and code.find_symbol(df, "TEST", fuzzy=True).where("name = 'test_f'").count() == 1
    assert code.file_summary(df).first().methods == ["m", "p"]
    js = spark.createDataFrame([("a.js", "export class B {}\nfunction go() {}\nconst run = async (x) => x\n")], "path string, source string")
    assert sorted((r.name, r.type) for r in code.script_units(js).collect()) == [("B", "class"), ("go", "function"), ("run", "arrow")]


@pytest.mark.parametrize("replies,rounds,resolved,uncertain", [
    (['{"findings": [{"claim": "a"}]}'], 1, 0, 0),
    (['{"contradictions": [{"topic": "x"}]}', 'So: {"resolved_claims": [{"verified_fact": "x"}]}'], 2, 1, 0),
    (['{"contradictions": [{"topic": "x"}]}', *['{"still_uncertain": [{"topic": "x"}]}'] * 3], 4, 0, 3),
    (['{"contradictions": [{"topic": "x"}]}', '{"resolved_claims": [{"verified_fact": "y"}], "still_uncertain": [{"topic": "x"}, "odd"]}', "nothing"], 3, 1, 1),
    (["no json"], 0, 0, 0),
])
def test_research_rounds(replies, rounds, resolved, uncertain):
    left = iter(replies)
    asked = []
    got = research.research("q", lambda prompt: asked.append(prompt) or next(left))
    assert (got.iterations, len(got.resolved), len(got.uncertain)) == (rounds, resolved, uncertain)


def test_next_speaker(spark):
    rows = [("user_proxy", "", "coordinator"), ("coordinator", "please verify", "verifier"), ("coordinator", "hm", "retriever"), ("retriever", "see section 2", "crossref"), ("retriever", "x", "summarizer"), ("crossref", "", "summarizer"), ("summarizer", None, "verifier"), ("verifier", "", "coordinator")]
    for r in spark.createDataFrame(rows, "a string, m string, w string").select("w", routing.next_speaker(F.col("a"), F.col("m")).alias("x")).collect():
        assert r.x == r.w


def test_open_items_are_asked_again_as_unknown():
    replies = iter(['{"contradictions": [{"topic": "t", "claim_a": "1", "claim_b": "2"}]}', '{"still_uncertain": [{"topic": "t", "reason": "r"}]}', "{}"])
    asked = []
    got = research.research("q", lambda prompt: asked.append(prompt) or next(replies))
    assert '"claim_a": "1"' in asked[1] and '"claim_a": "Unknown"' in asked[2] and '"topic": "t"' in asked[2]
    assert got.uncertain == [{"topic": "t", "reason": "r", "recommendation": ""}] and got.contradictions[0]["source_a"] == ""


def test_words_are_packed_as_full_as_they_go():
    rng = random.Random(2)
    for _ in range(200):
        words = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        size = rng.randint(1, 60)
        got = chunking.by_words("  ".join(words), size)
        assert " ".join(got).split() == words
        for a, b in zip(got, got[1:]):
            assert len(a) <= size or " " not in a
            assert len(a) + 1 + len(b.split()[0]) > size


def test_deep_and_circular_chains(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(14)] + [("a", "b"), ("b", "c"), ("c", "b"), ("self", "self"), ("lost", "gone")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string")
    got = {r.id: r.path for r in hierarchy.parent_chain(nodes, nodes).collect()}
    assert got["n13"] == [f"n{i}" for i in range(13)] and got["n0"] == [] and len(got) == len(rows)
    assert got["a"] == ["c", "b"] and got["b"] == ["c"] and got["self"] == [] and got["lost"] == ["gone"]
    assert {r.id: r.path for r in hierarchy.parent_chain(nodes, nodes.where("id = 'n13'"), depth=2).collect()} == {"n13": ["n11", "n12"]}


def test_a_conversation_turn(spark):
    knowledge = spark.createDataFrame([(1, "green apples taste sour"), (2, "apples and pears"), (3, "nothing here")], "id long, content string")
    turns = [(1, 0, "user", "Where do green apples grow?"), (1, 1, "assistant", "In trees."), (1, 2, "user", "What about the first one?"), (1, 3, "user", None), (2, 0, "user", "Tell of the first pears")]
    said = compose.converse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), knowledge, lambda p: p)
    got = {(r.conv_id, r.turn): r for r in said.collect()}
    assert got[1, 0].cited == [1, 2] and got[1, 0].rewritten is None and got[1, 0].answer == "source 1, source 2\n\nuser: Where do green apples grow?"
    assert got[1, 2].rewritten == "what about 'source 1' one?" and got[1, 2].answer.startswith("user: Where do green apples grow?\nassistant: In trees.")
    assert got[1, 3].cited == [] and got[2, 0].cited == [2] and len(got) == 4


def test_facts_of_a_conversation(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(7)] + [(2, 0, None, None)], "conv_id long, turn long, role string, text string")
    replies = lambda p: '[{"fact": "%s"}, {"fact": "b", "category": "c"}]' % p.replace("\n", "/") if "t2" in p else "none"
    got = sorted(map(tuple, conversation.extract_facts(turns, replies, 3, 2).collect()))
    assert got == [(1, 2, "USER: t1/USER: t2", "general"), (1, 2, "b", "c")]


def test_hierarchical_retrieval(spark):
    text = "# 1 One\n" + "first paragraph, long enough to be counted as one of them\nsecond paragraph that points to Section 2 and is long enough\n# 2 Two\nthe other section's own paragraph is long enough, too, it is"
    nodes = hierarchy.markdown_tree(spark.createDataFrame([(7, text)], "doc_id long, text string"))
    hits = nodes.where("node_type = 'paragraph'").select("id", "document_id", (1.0 / (1 + F.col("position"))).alias("score"))
    summaries = spark.createDataFrame([(7, 0.9), (8, 0.95)], "document_id long, score double")
    rows = compose.hierarchical(nodes, hits, summaries, hierarchy.references(nodes), k=2).orderBy("rank").collect()
    assert [r.id for r in rows] == ["d7.p1", "d7.p2"] and rows[1].parents == ["d7", "d7.s0"] and rows[1].siblings == ["d7.p1"]
    assert rows[1].referred == ["d7.s3"] and rows[1].citation == "[2] document 7 > One" and rows[1].context.endswith("Related:\n- [section] Two: # 2 Two")
    none = compose.hierarchical(nodes, hits, summaries, hierarchy.references(nodes), targets=spark.createDataFrame([(8,)], "document_id long"))
    assert none.count() == 0


def test_imports_and_importers(spark):
    files = spark.createDataFrame([("app/a.py", "import app.b\nfrom app import c\n"), ("app/b.py", "X = 1\nclass C: pass\n"), ("app/__init__.py", "class D: pass\n")], "path string, source string")
    units, imports = code.parse_units(files), code.parse_imports(files)
    got = {r.path: r for r in code.file_summary(units, imports).collect()}
    assert got["app/b.py"].importers == ["app/a.py"] and got["app/__init__.py"].importers == ["app/a.py"] and got["app/b.py"].imports == []
    js = spark.createDataFrame([("a.js", "import x from './b'\nconst y = require(\"c\")\nimport('d')\nimport 'e'\n")], "path string, source string")
    assert sorted(r.module for r in code.script_imports(js).collect()) == ["./b", "c", "d", "e"]


def test_digest_vectors():
    got = tools.digest_embedding("text", 20)
    assert len(got) == 20 and got[:8] == got[8:16] and got[16:] == got[:4] and all(-1 <= x <= 1 for x in got)


def test_chunk_store(spark):
    rows = chunking.store(spark.createDataFrame([(3, "a b. " * 400), (4, None)], "doc_id long, text string")).collect()
    assert {r.id for r in rows} == {3} and all(len(r.chunk) <= 500 for r in rows) and rows[0].chunk_id == "3_chunk_0"


def test_recent_values_skip_turns_without_one(spark):
    rng = __import__("random").Random(4)
    rows = [(c, t, rng.choice([None, None, f"v{t}"])) for c in range(6) for t in range(25)]
    got = {(r.conv_id, r.turn): r.last for r in conversation.recent(spark.createDataFrame(rows, "conv_id long, turn long, v string").repartition(3), "v", 3, "last").collect()}
    assert got == {(c, t): [v for d, u, v in rows if d == c and u < t and v][-3:] for c, t, _ in rows}


@pytest.mark.parametrize("name", ["agentic_results", "agentic_answers"])
def test_questions_that_share_an_id_or_end_in_a_year_equal_the_sql(spark, tmp_path, name):
    """Conversation 2023 is no year, and turn 100 of a conversation has the next one's ids."""
    import duckdb

    import __spark_entry__ as entry

    turns = [(c, t, "user", "x") for c in (2022, 2023, 2024) for t in (*range(16), 100, 101, 108)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "news about topic 2023"), (2, "write some code")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(entry.queries()[name](spark, str(tmp_path)).collect()) == key(con.execute(entry.oracle_sql()[name]).fetchall())


def test_chunks_leave_a_task_in_small_batches(spark):
    """The Python memory of a task is that of some texts, not of Spark's whole batch."""
    import pyarrow as pa

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x " * 900, None] * 500)], ["id", "text"])
    out = list(chunking.chunk(Files(), chunking.by_chars)(iter([batch])))
    assert max(b.num_rows for b in out) <= 3 * chunking.TEXTS
    assert [(i, c) for b in out for i, c in zip(b["id"].to_pylist(), b["chunk"].to_pylist())] == [(i, c) for i in range(0, 1000, 2) for c in chunking.by_chars("x " * 900)]
