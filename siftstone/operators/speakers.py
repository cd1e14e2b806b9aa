"""Runs of several agents to their end, for all questions at once.

A run is a table of what was said: (qid, step, speaker, message).  Each round takes the
runs that go on, tells from who spoke last, and what, who speaks next, and lets them
speak; ``say`` is a function of the frame, so a provider answers a round's prompts as
one batch.  A round's rows are written before the next reads them.  A run ends when a
message holds ``STOP``, when its mode has nobody left to speak, or at the limit of
rounds, which the outcome reports.

Modes: ``group`` (the coordinator hands over by what is asked for, and speaks again after
the verifier), ``sequence`` (four agents in a row), ``pair`` (an assistant and the
user's proxy in turn).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.lineage import kept
from siftstone.functions.routing import next_speaker

#: The word that ends a run, the order of a sequence, and what a pair without an answer says.
STOP = "TERMINATE"
SEQUENCE = ("user_proxy", "coordinator", "retriever", "summarizer", "verifier")
NO_ANSWER = "No answer generated."
#: Whose last message is the answer.
ANSWERS = {"group": "coordinator", "sequence": "summarizer", "pair": "assistant"}
LIMIT = 12


def following(mode: str, last: Column, message: Column) -> Column:
    """Who speaks after ``last``; null: nobody."""
    if mode == "group":
        return next_speaker(last, message)
    if mode == "pair":
        return F.when(last == "assistant", "user_proxy").otherwise("assistant")
    if mode == "sequence":
        out = F.lit(None).cast("string")
        for a, b in zip(SEQUENCE, SEQUENCE[1:]):
            out = F.when(last == a, b).otherwise(out)
        return out
    raise ValueError(f"no mode {mode!r}")


def run(questions: DataFrame, say: Callable[[DataFrame], DataFrame], mode: str = "group", limit: int = LIMIT) -> DataFrame:
    """(qid, step, speaker, message) of all questions (qid, question).  ``say`` is given
    rows (qid, question, step, speaker, last_speaker, last_message) and adds ``message``."""
    names = ("qid", "question", "step", "speaker", "message")
    last = kept(questions.select("qid", "question", F.lit(0).alias("step"), F.lit("user_proxy").alias("speaker"), F.coalesce("question", F.lit("")).alias("message")))
    said = last
    for step in range(1, limit + 1):
        who = following(mode, F.col("speaker"), F.col("message"))
        # The first message is the question itself and ends nothing.
        going = last.where(~F.contains("message", F.lit(STOP)) | (F.col("step") == 0))
        turn = going.select("qid", "question", F.lit(step).alias("step"), who.alias("next"), F.col("speaker").alias("last_speaker"), F.col("message").alias("last_message")).withColumnRenamed("next", "speaker")
        last = kept(say(turn.where("speaker is not null")).withColumn("message", F.coalesce("message", F.lit(""))).select(*names))
        if last.isEmpty():
            break
        said = said.unionByName(last)
    return said.select("qid", "step", "speaker", "message")


def outcomes(said: DataFrame, mode: str = "group", limit: int = LIMIT) -> DataFrame:
    """(qid, steps, ended, answer): ``ended`` is done, or limit where the run was cut."""
    mine = (F.col("speaker") == ANSWERS[mode]) & (F.col("step") > 0)
    out = said.groupBy("qid").agg(F.max("step").cast("int").alias("steps"), F.max_by("message", "step").alias("end"), F.max_by("speaker", "step").alias("who"), F.max_by(F.when(mine, F.col("message")), F.when(mine, F.col("step"))).alias("answer"))
    over = F.contains("end", F.lit(STOP)) & (F.col("steps") > 0) | ((F.col("who") == SEQUENCE[-1]) if mode == "sequence" else F.lit(False))
    clean = F.btrim(F.replace("answer", F.lit(STOP), F.lit("")))
    return out.select("qid", "steps", F.when(over | (F.col("steps") < limit), "done").otherwise("limit").alias("ended"), F.coalesce(clean, F.lit(NO_ANSWER)).alias("answer"))
