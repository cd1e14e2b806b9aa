from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.operators import speakers

QUESTIONS = [(1, "What?"), (2, "TERMINATE is a word"), (3, None), (4, "long " * 9)]


def talk(turn):
    """Says its name and the step; the third question's agents never stop, others after 6 steps."""
    stop = F.when((F.col("step") >= 6) & (F.col("qid") != 3), " TERMINATE").otherwise("")
    return turn.withColumn("message", F.when((F.col("speaker") == "coordinator") & (F.col("qid") == 4), F.lit("please verify")).otherwise(F.concat("speaker", F.lit(" "), F.col("step").cast("string"), stop)))


def walk(qid, question, mode, limit):
    out, last, message = [(0, "user_proxy", question or "")], "user_proxy", question or ""
    for step in range(1, limit + 1):
        if mode == "pair":
            who = "user_proxy" if last == "assistant" else "assistant"
        elif mode == "sequence":
            at = speakers.SEQUENCE.index(last) + 1
            if at == len(speakers.SEQUENCE):
                break
            who = speakers.SEQUENCE[at]
        else:
            said = message.lower()
            if last == "coordinator":
                who = next((w for phrases, w in ((("search", "retrieve"), "retriever"), (("reference", "citation"), "crossref"), (("summarize", "synthesize"), "summarizer"), (("verify", "check"), "verifier")) if any(p in said for p in phrases)), "retriever")
            elif last == "retriever":
                who = "crossref" if "reference" in said or "see section" in said else "summarizer"
            else:
                who = {"crossref": "summarizer", "summarizer": "verifier"}.get(last, "coordinator")
        message = "please verify" if who == "coordinator" and qid == 4 else f"{who} {step}" + (" TERMINATE" if step >= 6 and qid != 3 else "")
        out.append((step, who, message))
        last = who
        if "TERMINATE" in message:
            break
    return out


def test_runs_equal_a_walk_in_every_mode(spark):
    questions = spark.createDataFrame(QUESTIONS, "qid long, question string")
    for mode in ("group", "sequence", "pair"):
        said = speakers.run(questions, talk, mode, limit=9)
        got = {}
        for r in said.orderBy("qid", "step").collect():
            got.setdefault(r.qid, []).append((r.step, r.speaker, r.message))
        want = {q: walk(q, text, mode, 9) for q, text in QUESTIONS}
        assert got == want, mode
        ends = {r.qid: r for r in speakers.outcomes(said, mode, 9).collect()}
        for q, steps in want.items():
            cut = steps[-1][0] == 9 and "TERMINATE" not in steps[-1][2]
            assert (ends[q].steps, ends[q].ended) == (steps[-1][0], "limit" if cut else "done")
            mine = [m for s, w, m in steps if w == speakers.ANSWERS[mode] and s]
            assert ends[q].answer == (mine[-1].replace("TERMINATE", "").strip() if mine else speakers.NO_ANSWER)
    assert speakers.run(questions.limit(0), talk).count() == 0


def test_a_run_without_rounds_has_no_answer(spark):
    said = speakers.run(spark.createDataFrame([(1, "a")], "qid long, question string"), talk, "pair", limit=0)
    assert [tuple(r) for r in speakers.outcomes(said, "pair", 0).collect()] == [(1, 0, "limit", speakers.NO_ANSWER)]
