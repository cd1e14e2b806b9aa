"""A bounded loop of research and verification over JSON replies.

The model is any function from a prompt to text; replies are parsed as tables.
The first reply gives findings and contradictions; each round of verification
asks about what is open, and what stays uncertain is asked again as a pair of
unknown claims, until nothing is or the rounds are used up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 3
#: The keys of each kind of reply item, with what stands for a missing one.
FINDING = {"claim": "", "sources": [], "confidence": "medium", "notes": ""}
CONTRADICTION = {"topic": "", "claim_a": "", "source_a": "", "claim_b": "", "source_b": ""}
RESOLVED = {"original_contradiction": "", "verified_fact": "", "explanation": "", "confidence": "medium", "sources": []}
UNCERTAIN = {"topic": "", "reason": "", "recommendation": ""}


@dataclass
class Research:
    question: str
    findings: list[dict] = field(default_factory=list)
    contradictions: list[dict] = field(default_factory=list)
    resolved: list[dict] = field(default_factory=list)
    uncertain: list[dict] = field(default_factory=list)
    summary: str = ""
    iterations: int = 0


def rescue(reply: str) -> dict:
    """The outermost JSON object of a reply, or an empty one."""
    found = re.search(r"\{.*\}", reply or "", re.S)
    try:
        value = json.loads(found[0]) if found else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def items(reply: dict, key: str, kind: dict) -> list[dict]:
    """The objects under a key of a reply, in the shape of their kind."""
    listed = reply.get(key)
    return [{k: x.get(k, default) for k, default in kind.items()} for x in listed if isinstance(x, dict)] if isinstance(listed, list) else []


def research(question: str, ask: Callable[[str], str], rounds: int = ROUNDS) -> Research:
    """One question's research.  An unreadable first reply gives an empty
    result without a round, an unreadable later one ends the loop."""
    out, first = Research(question), rescue(ask(f"Research: {question}"))
    if not first:
        return out
    out.iterations, out.summary = 1, first.get("summary") or ""
    out.findings, out.contradictions = items(first, "findings", FINDING), items(first, "contradictions", CONTRADICTION)
    open_ = out.contradictions
    while open_ and out.iterations <= rounds:
        out.iterations += 1
        reply = rescue(ask("Verify: " + json.dumps(open_, ensure_ascii=False)))
        if not reply:
            break
        out.resolved += items(reply, "resolved_claims", RESOLVED)
        still = items(reply, "still_uncertain", UNCERTAIN)
        out.uncertain += still
        open_ = [CONTRADICTION | {"topic": u["topic"], "claim_a": "Unknown", "claim_b": "Unknown"} for u in still]
    return out


_OUT = "question string, findings int, contradictions int, resolved int, uncertain int, iterations int, result string"


def research_all(questions: DataFrame, ask: Callable[[str], str], rounds: int = ROUNDS, column: str = "question") -> DataFrame:
    """A row a question with counts and the whole result as JSON; ``ask`` runs
    on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [research(q, ask, rounds) for q in batch.column(0).to_pylist() if q is not None]
            lists = ([r.question for r in made], *([len(getattr(r, k)) for r in made] for k in ("findings", "contradictions", "resolved", "uncertain")), [r.iterations for r in made], [json.dumps(asdict(r), sort_keys=True) for r in made])
            kinds = [pa.string(), *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds)], [c.split()[0] for c in _OUT.split(", ")])

    return questions.select(F.col(column).alias("question")).mapInArrow(run, _OUT)
