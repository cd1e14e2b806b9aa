"""Chat formatting by incremental black-box rendering.

A template is only asked to render lists of turns.  Every prefix of a
conversation is rendered, at any length, and each output is compared with the
one before: if it starts with it, the rest is the new turn's span; if not, the
template has rewritten history, and the conversation is reported with the turn
where that first shows.  Spans found before that turn stay as far as the whole
conversation's rendering still begins with the text they were found in.  Within
a span the text's own place is found by rendering the last turn with two
different probe characters: where those outputs first differ the text starts,
and what follows the probe closes the turn.  Only turns of the trained role are
probed; their texts make up the loss mask, in code points of the formatted
text.  The result is always what the template gives for the whole conversation.

Rendering all prefixes costs the square of a conversation's length, about two
renderings a turn; it is the price of trusting nothing about the template.

Rows: a null text or role is empty; turns are ordered by number (null first),
then role and text, so that ties and repeated rows have one order and all stay;
a row with a null conversation id is a conversation of its own, so that such rows
form no group; columns other than the four are ignored.  A conversation without
rows does not occur; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

TRAINED = "assistant"
PROBES = ("\ue000", "\ue001")
#: What the template writes itself, and its escape character.
CONTROLS = ("\\", "###", "</turn>", ":")
_ESCAPE = re.compile("|".join(re.escape(c) for c in CONTROLS[:3]))
_ESCAPE_ROLE = re.compile("|".join(re.escape(c) for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """Put a backslash before every control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_template(turns: Turns) -> str:
    """The engine's own template: ``### role: text</turn>`` and a line feed."""
    return "".join(f"### {_ESCAPE_ROLE.sub(lambda m: chr(92) + m[0], role)}: {escape(text)}</turn>\n" for role, text in turns)


def parse(formatted: str) -> Turns:
    """Read the turns of ``turn_template`` back."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def shared(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def locate(render: Template, turns: Turns, trained: str | None = None) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The formatted conversation; for each turn its span and its text's span
    (with ``trained``, the text's span is empty for other roles); and the first
    turn whose rendering changed what came before it, or None (spans stop there,
    and are those of the rendering before it)."""
    before, found = render([]), []
    for i, (role, text) in enumerate(turns):
        now = render(turns[: i + 1])
        if not now.startswith(before):
            return render(turns), found, i
        inner = (len(now), len(now))
        if trained is None or role == trained:
            one, two = (render([*turns[:i], (role, p)]) for p in PROBES)
            first = shared(one, two)
            if first < min(len(one), len(two)):  # else the template does not show the text
                inner = (first, len(now) - (len(one) - first - 1))
        found.append((len(before), len(now), *inner))
        before = now
    return before, found, None


_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()),
                  ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("rewritten_at", pa.int32())])


def _format(render: Template, trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: [] for name in _OUT.names}
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = [(t["role"] or "", t["text"] or "") for t in turns]
                formatted, spans, broken = locate(render, pairs, trained)
                if broken is not None:
                    safe = shared(formatted, render(pairs[:broken]))
                    spans = [s for s in spans if s[1] <= safe]
                rows["conv_id"].append(conv)
                rows["formatted"].append(formatted)
                rows["n_turns"].append(len(pairs))
                rows["loss_spans"].append([{"start": s[2], "stop": s[3]} for (role, _), s in zip(pairs, spans) if role == trained])
                rows["rewritten_at"].append(broken)
            yield pa.RecordBatch.from_pydict(rows, schema=_OUT)

    return run


def format_conversations(turns: DataFrame, render: Template = turn_template, trained: str = TRAINED) -> DataFrame:
    """Rows (conv_id, formatted, n_turns, loss_spans, rewritten_at).  Where the
    template rewrites history ``rewritten_at`` says at which turn, and the loss
    mask holds the spans that the rewriting left in place."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows without an id are dealt out one by one.
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone"), turn.alias("t"))
    whole = slim.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", "turns")
    return whole.mapInArrow(_format(render, trained), "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:int,stop:int>>, rewritten_at int")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            turns = parse(formatted)
            trained = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in spans)
            digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": digest("".join(f"{r}\n{t}\n" for r, t in turns)),
                         "loss_chars": len(trained), "loss_sha256": digest(trained), "formatted_chars": len(formatted)})
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def op1_query(spark, sf_dir: str) -> DataFrame:
    """All conversations and one more, number -7, whose texts hold control strings."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = format_conversations(turns).select("conv_id", "formatted", "loss_spans")
    return out.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same rows: what the template adds is 14 characters a turn and one a control string.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
