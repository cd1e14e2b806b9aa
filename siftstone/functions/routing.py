"""Rule-based routing, intents, query classes, rewriting tests, tool arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import contains_any, matches_any

# Patterns and phrases that decide the results.
CALCULATION = (r"\b\d+\s*[\+\-\*\/\^]\s*\d+", r"\bcalculate\b", r"\bcompute\b", r"\bwhat is \d+", r"\bhow much is\b", r"\bsolve\b.*\bequation\b", r"\bsqrt\b|\bsquare root\b", r"\bpercentage\b|\b%\b")
CLOCK = (r"\bwhat time\b", r"\bwhat date\b", r"\bwhat day\b", r"\bcurrent time\b", r"\bcurrent date\b")
CODE = (r"\bwrite\b.*\bcode\b", r"\bpython\b.*\bscript\b", r"\bprogram\b.*\bto\b", r"\bexecute\b.*\bcode\b", r"\brun\b.*\bpython\b")
YEAR = r"\b202[3-9]\b"
CURRENT = (r"\bcurrent\b", r"\btoday\b", r"\brecent\b", r"\blatest\b", r"\bnow\b", r"\bthis week\b", r"\bthis month\b", YEAR)
LOOKUP = (r"\baccording to\b", r"\bfind\b.*\bdocument\b", r"\bsearch\b.*\bknowledge\b", r"\bin my\b.*\bfiles\b", r"\bwhat did\b.*\bsay about\b", r"\blook up\b")
INTENTS = {
    "factual": ("what is", "who is", "where is", "when did", "how many"),
    "procedural": ("how to", "how do i", "steps to", "guide for"),
    "comparative": ("compare", "difference between", "vs", "better than"),
    "analytical": ("why", "explain", "analyze", "reason for"),
    "creative": ("write", "create", "generate", "compose"),
    "computational": ("calculate", "compute", "solve", "evaluate"),
    "retrieval": ("find", "search", "look up", "get me"),
}
CROSS_REFERENCE = ("related to", "connection", "linked", "referenced", "see also")
BROAD = ("overview", "summary", "what is", "explain", "describe", "main")
PRONOUNS = ("it", "they", "this", "that", "these", "those", "its", "their")
REFERRING = (
    "the first", "the second", "the third", "the last", "the previous", "the next", "the other", "that one", "this one", "the same", "mentioned earlier", "discussed before",
    "the document", "the section", "the paragraph", "tell me more", "more about", "continue", "what else", "anything else", "go on", "elaborate", "expand on", "more details",
    "what about", "how about", "what's the difference", "which is better", "compare them", "versus", " vs ",
)
MORE = ("tell me more", "more about this", "elaborate")
ORDINALS = (("the first", 0), ("the second", 1), ("the third", 2), ("the last", -1), ("the previous", -1))
#: Route names with their tool, confidence and patterns, in order of precedence.
ROUTES = (("tool_use", "calculator", 0.9, CALCULATION), ("tool_use", "datetime", 0.9, CLOCK), ("tool_use", "code_executor", 0.85, CODE), ("web_search", "web_search", 0.8, CURRENT), ("retrieval", None, 0.85, LOOKUP))


def without(pattern: str) -> tuple:
    """``ROUTES`` less one pattern."""
    return tuple((name, tool, confidence, tuple(p for p in patterns if p != pattern)) for name, tool, confidence, patterns in ROUTES)


def route(question: Column, tools: Sequence[str] = ("calculator", "datetime", "code_executor", "web_search"), routes: Sequence[tuple] = ROUTES) -> Column:
    """struct(route, tool, confidence); null where no rule decides."""
    asked, out = F.lower(question), None
    for name, tool, confidence, patterns in routes:
        if tool is None or tool in set(tools):
            value = F.struct(F.lit(name).alias("route"), F.lit(tool).cast("string").alias("tool"), F.lit(confidence).alias("confidence"))
            out = F.when(matches_any(asked, patterns), value) if out is None else out.when(matches_any(asked, patterns), value)
    return out


def intent(question: Column) -> Column:
    """struct(intent, confidence): the first intent with the most phrases."""
    asked = F.lower(question)
    hits = {name: sum((asked.contains(p).cast("int") for p in phrases[1:]), asked.contains(phrases[0]).cast("int")) for name, phrases in INTENTS.items()}
    most = F.greatest(*hits.values())
    name = F.when(most == 0, "unknown")
    for k, v in hits.items():
        name = name.when(v == most, k)
    return F.struct(name.alias("intent"), F.least(most / 2, F.lit(1.0)).alias("confidence"))


def query_class(question: Column) -> Column:
    asked = F.lower(question)
    return F.when(contains_any(asked, CROSS_REFERENCE), "cross-reference").when(contains_any(asked, BROAD), "broad").otherwise("specific")


def needs_rewriting(question: Column) -> Column:
    """A pronoun as a word, a referring phrase, or at most three words with a
    question mark."""
    asked = F.lower(question)
    words = F.filter(F.split(asked, r"\s+"), lambda w: w != "")
    return F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS))) | contains_any(asked, REFERRING) | ((F.size(words) <= 3) & question.contains("?"))


def pick(items: Column, index: int) -> Column:
    """An item from the front, or the last for -1; null if there is none."""
    return F.get(items, F.size(items) - 1) if index < 0 else F.get(items, F.lit(index))


def rewrite(question: Column, citations: Column, entities: Column) -> Column:
    """Rule rewrite from recent citations and entities (arrays, newest last for
    entities); null where a rule does not apply."""
    asked = F.lower(question)
    out = F.when(contains_any(asked, MORE), F.concat(F.lit("Tell me more about "), pick(entities, -1)))
    for phrase, index in ORDINALS:
        named = F.coalesce(pick(citations, index), pick(entities, index))
        out = out.when(asked.contains(phrase) & named.isNotNull(), F.replace(asked, F.lit(phrase), F.concat(F.lit("'"), named, F.lit("'"))))
    return out


def tool_argument(tool: Column, question: Column) -> Column:
    numbers = F.array_join(F.regexp_extract_all(question, F.lit(r"([\d\.\+\-\*\/\(\)\^]+)"), F.lit(1)), " ")
    asked = F.lower(question)
    clock = F.when(asked.contains("time"), "time").when(asked.contains("date"), "date").when(asked.contains("day"), "weekday").otherwise("now")
    return F.when(tool == "calculator", F.when(numbers != "", numbers).otherwise(question)).when(tool == "datetime", clock).otherwise(question)


#: Who speaks after the coordinator, by what it asks for, in order.
NEXT = ((("search", "retrieve"), "retriever"), (("reference", "citation"), "crossref"), (("summarize", "synthesize"), "summarizer"), (("verify", "check"), "verifier"))


def next_speaker(last: Column, message: Column) -> Column:
    """The agent after ``last``, who said ``message``."""
    said = F.lower(F.coalesce(message, F.lit("")))
    from_coordinator = F.lit("retriever")
    for phrases, who in reversed(NEXT):
        from_coordinator = F.when(contains_any(said, phrases), who).otherwise(from_coordinator)
    after_search = F.when(contains_any(said, ("reference", "see section")), "crossref").otherwise("summarizer")
    return (F.when(last == "coordinator", from_coordinator).when(last == "retriever", after_search).when(last == "crossref", "summarizer")
            .when(last == "summarizer", "verifier").otherwise("coordinator"))
