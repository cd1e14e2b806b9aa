from __future__ import annotations

import hashlib
import random

from siftstone.llm import chat

TURNS = [("assistant" if i % 2 else "user", f"text {i} of the talk") for i in range(300)]


def numbered(turns):
    return "".join(f"[{i}] {r}: {t}\n" for i, (r, t) in enumerate(turns))


def last_150(turns):
    return "".join(f"{r}: {t}\n" for r, t in turns[-150:])


def test_a_template_that_numbers_turns():
    formatted, spans, broken = chat.locate(numbered, TURNS)
    assert broken is None and formatted == numbered(TURNS)
    assert [formatted[s[2] : s[3]] for s in spans] == [t for _, t in TURNS]
    assert "".join(formatted[s[0] : s[1]] for s in spans) == formatted


def test_a_template_that_drops_old_turns():
    formatted, spans, broken = chat.locate(last_150, TURNS)
    assert broken == 150 and formatted == last_150(TURNS) and len(spans) == 150


def test_a_late_rewrite_of_an_early_turn():
    def late(turns):
        return "".join(f"{r}: {'gone' if i == 0 and len(turns) > 150 else t}\n" for i, (r, t) in enumerate(turns))

    formatted, spans, broken = chat.locate(late, TURNS)
    assert broken == 150 and formatted == late(TURNS) and len(spans) == 150


def test_spans_before_a_rewrite_stay_where_they_hold(spark):
    def folds_last(turns):  # the turn before the last is folded once the talk has 200 turns
        return "".join(f"{r}: {'...' if i == 198 and len(turns) == 200 else t}\n" for i, (r, t) in enumerate(turns))

    rows = [(1, i, r, t) for i, (r, t) in enumerate(TURNS[:200])]
    row = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), folds_last).first()
    assert row.rewritten_at == 199 and row.formatted == folds_last(TURNS[:200])
    assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == [t for r, t in TURNS[:198] if r == "assistant"]


def test_query_matches_brute_force_and_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    bits = ["a", "\\", "###", "</turn>", ":", "\n", "é", "☃", " ", "### Assistant: ", "<", "#", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "o:d"]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(30)))]), c) for c in range(40) for t in rng.sample(range(20), 6)]
    rows += rows[:3] + [(50, i, "assistant" if i % 2 else "user", f"turn {i} " * 40, 1) for i in range(160)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op1_query(spark, str(tmp_path))
    nasty = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", nasty), ("assistant", nasty)]}
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x, _ in rows)):
        talks.setdefault(c, []).append((r, x))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for c, turns in talks.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        expected.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), len(chat.turn_template(turns))))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(chat.OP1_SQL)
    names = [d[0] for d in cur.description]
    assert names == got.columns and sorted(cur.fetchall()) == sorted(expected)
