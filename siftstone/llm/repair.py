"""Conversation structure repair by lazy weighted determinisation.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Edits cost:
Keep 0, Rerole 1, Delete 2, Insert 5; a truncated row that is not deleted adds 5;
blank and duplicate rows must be deleted.  That is a weighted automaton of four
states (start, after system, after user, after assistant).  Its cost vector, the
cheapest way into each state, is made relative to its least entry; each such vector
is a state of a deterministic automaton that is built as rows ask for it, and kept
in a transition table (``Machine``) with the weight that was taken off.  Reading a
conversation through the table gives its cost.  Backwards, over arcs that are tight
(their cost is the difference of the entries they join), goes the mark of what lies
on a cheapest path; among the marked arcs the ASCII-least edit of each step is the
audit.

An entry that a constant bound shows to lose by more than any future can win back
is dropped (see ``Machine.closed``), so the table stays finite, a few dozen states
however long a conversation is; nothing on a cheapest path is dropped, ties included.

A conversation's rows are put in order by ranges over all of them (id, turn, role,
beginning of the text), so one with very many rows or long texts is spread over tasks.
Only its tape, a character a row, comes together in a task, as its audit does in
a row of the result; texts are joined to their edits by place, never gathered.
``repaired_sha256`` is one hash over all of a conversation's rows, by its definition a
sequential one: they stream through a task, a batch in memory at a time.

Rows: a null role or text is one space, and so is a null id or turn in the damage's
key; rows with a null id are one conversation (id null); turns are ordered null
first, ties by role, then text, so that repeated rows are adjacent and all but the first
are duplicates; a role with another initial than s, u or a, or none, cannot be kept;
texts are taken whole, however long.  Other columns are ignored, whatever their
names.  A conversation without rows after the damage gets zeros, an empty audit and the
hash of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, shuffle_width, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: A row on the tape: role class (s, u, a, other) and fault (none, truncated, blank,
#: duplicate); "-" is a row that the damage dropped.
TAPE = "suaxSUAX01234567"
DROPPED = "-"
NONE = 1 << 60
#: By state: what a kept role leads to, what Insert and Rerole write, and where that leads.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WRITES, LEADS = "uuau", (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
#: Adjacent role classes that are legal.
LEGAL = {"su", "ua", "au"}


class Machine:
    """The deterministic automaton, built as it is used.  State numbers stand for
    relative cost vectors; ``table[state, symbol]`` is (next state, weight)."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.marks: dict[tuple[int, str, int], int] = {}
        self.steps: dict[tuple[int, str, int, int], tuple[str, str, int]] = {}
        self.first, _ = self.state([0, NONE, NONE, NONE])

    @staticmethod
    def closed(v: list[int]) -> list[int]:
        """``v`` with insertions.  Entries that lose for sure are dropped: what
        follows from SYSTEM can follow from ASSISTANT at the same cost, and what
        follows from START too, if its system row is deleted."""
        v[USER] = min(v[USER], min(v[START], v[SYSTEM], v[ASSISTANT]) + INSERT)
        v[ASSISTANT] = min(v[ASSISTANT], v[USER] + INSERT)
        if v[START] > v[ASSISTANT] + DELETE:
            v[START] = NONE
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = NONE
        return v

    def state(self, v: list[int]) -> tuple[int, int]:
        v = self.closed(v)
        least = min(v)
        rest = tuple(x - least if x < NONE else NONE for x in v)
        if rest not in self.numbers:
            self.numbers[rest] = len(self.vectors)
            self.vectors.append(rest)
        return self.numbers[rest], least

    @staticmethod
    def arcs(q: int, symbol: str) -> list[tuple[str, int, int, str]]:
        """(edit, cost, state, what is written) of a row, in ASCII order of the edits."""
        kind, role = divmod(TAPE.index(symbol), 4)
        out = [("D", DELETE, q, "")]
        if kind < 2:
            more = TRUNCATED * kind
            if TAPE[role] in ROLES[q]:
                out.append(("K", KEEP + more, ROLES[q][TAPE[role]], "K"))
            out.append(("R", REROLE + more, LEADS[q], WRITES[q].upper()))
        return out

    def next(self, state: int, symbol: str) -> tuple[int, int]:
        found = self.table.get((state, symbol))
        if found is None:
            v, into = self.vectors[state], [NONE] * 4
            for q in range(4):
                if v[q] < NONE:
                    for _, cost, to, _ in self.arcs(q, symbol):
                        into[to] = min(into[to], v[q] + cost)
            found = self.table[state, symbol] = self.state(into)
        return found

    def inserted(self, state: int, mark: int) -> int:
        """``mark`` and the states that reach it by tight insertions."""
        v = self.vectors[state]
        for _ in range(2):
            for q in range(4):
                if v[q] < NONE and mark >> LEADS[q] & 1 and v[q] + INSERT == v[LEADS[q]]:
                    mark |= 1 << q
        return mark

    def mark(self, state: int, symbol: str, after: int) -> int:
        """Bits of the states before a row that lie on a cheapest path, given those after it."""
        found = self.marks.get((state, symbol, after))
        if found is None:
            v, (to_state, weight) = self.vectors[state], self.next(state, symbol)
            w, found = self.vectors[to_state], 0
            for q in range(4):
                if v[q] < NONE and any(after >> to & 1 and v[q] + cost == w[to] + weight for _, cost, to, _ in self.arcs(q, symbol)):
                    found |= 1 << q
            found = self.marks[state, symbol, after] = self.inserted(state, found)
        return found

    def step(self, state: int, symbol: str, after: int, q: int) -> tuple[str, str, int]:
        """From q the ASCII-least edits that take a row, what they write, and where they lead."""
        found = self.steps.get((state, symbol, after, q))
        if found is None:
            v, (to_state, weight) = self.vectors[state], self.next(state, symbol)
            w, mark = self.vectors[to_state], self.mark(state, symbol, after)
            tight = {edit: (to, made) for edit, cost, to, made in self.arcs(q, symbol) if after >> to & 1 and v[q] + cost == w[to] + weight}
            if "D" not in tight and mark >> LEADS[q] & 1 and v[q] + INSERT == v[LEADS[q]]:
                edits, made, to = self.step(state, symbol, after, LEADS[q])
                found = "I" + edits, WRITES[q] + made, to
            else:
                edit = min(tight)
                found = edit, tight[edit][1], tight[edit][0]
            self.steps[state, symbol, after, q] = found
        return found

    def read(self, tape: str) -> tuple[int, str, list[str]]:
        """(cost, audit, what each row's edits write) of a tape.  Written are: u, a
        an empty row; K the row; U, A the row with that role."""
        at, state, cost = [i for i, x in enumerate(tape) if x != DROPPED], self.first, 0
        states = [state]
        for i in at:  # the table scan
            state, weight = self.next(state, tape[i])
            cost += weight
            states.append(state)
        v = self.vectors[state]
        rest = min(v[q] for q in ENDS)
        final = sum(1 << q for q in ENDS if v[q] == rest)
        marks = [self.inserted(state, final)]
        for i, before in zip(reversed(at), reversed(states[:-1])):  # the backward trace
            marks.append(self.mark(before, tape[i], marks[-1]))
        marks.reverse()
        q, audit, made = START, [], [""] * len(tape)
        for n, i in enumerate(at):
            edits, made[i], q = self.step(states[n], tape[i], marks[n + 1], q)
            audit.append(edits)
        while at and not final >> q & 1:  # empty rows at the end
            audit.append("I")
            made[at[-1]] += WRITES[q]
            q = LEADS[q]
        return cost + rest, "".join(audit), made


_VERDICT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
                      ("edits", pa.list_(pa.struct([("first_at", pa.int64()), ("made", pa.list_(pa.string()))])))])
VERDICT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<first_at:long,made:array<string>>>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Machine()
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tape = "".join(p["tape"] for p in pieces)
            cost, audit, made = machine.read(tape)
            edits, at = [], 0
            for p in pieces:
                edits.append({"first_at": p["first_at"], "made": made[at : at + len(p["tape"])]})
                at += len(p["tape"])
            timed = [p for p in pieces if p["low"] is not None]
            distinct = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
            rows = [TAPE.index(x) for x in tape if x != DROPPED]
            role = "".join(TAPE[x % 4] for x in rows)
            counts = [sum(x // 4 == k for x in rows) for k in range(4)]
            out.append({"conv_id": conv, "gaps": timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0, "truncated": counts[1], "blank": counts[2], "duplicate": counts[3],
                        "illegal": sum(a + b not in LEGAL for a, b in zip(role, role[1:])), "cost": cost, "audit": audit, "edits": edits})
        yield pa.RecordBatch.from_pylist(out, schema=_VERDICT)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows with the damage that the crc32
    of ``conv_id:turn`` names; dropped rows stay, marked."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    harm = F.crc32(F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("harm") == 0).alias("dropped"), times.alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, dropped) in order: ``at`` rises with
    id, turn, role and text; its upper bits are the range that a row is in."""
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role")
    ranges = rows.repartitionByRange(shuffle_width(rows), *order, F.substring("text", 1, 64))
    return ranges.sortWithinPartitions(*order, "text").withColumn("at", F.monotonically_increasing_id())


def judged(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``placed`` rows: counts, cost, audit and, for each
    range, what the edits of its rows write."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    role = F.substring("role", 1, 1)
    slim = rows.select(
        "conv_id", "turn", "at", "dropped", (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(*".!?")).alias("cut"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("role"),
        F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.char_length("role"), "role", "text"), 256).alias("same"))
    firsts = slim.where("not dropped").groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), 2).when(F.col("at") > F.col("first"), 3).when(F.col("cut"), 1).otherwise(0)
    symbol = F.when(F.col("dropped"), DROPPED).otherwise(F.substring(F.lit(TAPE), 4 * fault + F.col("role") + 1, F.lit(1)))
    turn = F.when(~F.col("dropped"), F.col("turn"))
    piece = slim.join(firsts, "same", "left").groupBy("conv_id", F.shiftright("at", 33).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("at", symbol.alias("symbol")))).alias("x"), F.min(turn).alias("low"), F.max(turn).alias("high"), F.size(F.collect_set(turn)).alias("turns"))
    of = F.struct("piece", F.get("x.at", F.lit(0)).alias("first_at"), F.array_join("x.symbol", "").alias("tape"), "low", "high", "turns")
    return piece.groupBy("conv_id").agg(F.array_sort(F.collect_list(of)).alias("pieces")).mapInArrow(_judge, VERDICT)


def _line(made: Column) -> Column:
    """(role, text) of each thing that a row's edits write."""
    role = lambda x: F.when(F.lower(x) == "u", "user").when(F.lower(x) == "a", "assistant").otherwise(F.col("role"))
    text = lambda x: F.when(x.isin("u", "a"), "").otherwise(F.col("text"))
    return F.transform(F.regexp_extract_all(made, F.lit("."), 0), lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def written(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv_id, at, lines): what each row becomes, an array of (role, text);
    rows that are deleted without a trace are left out."""
    made = verdicts.select(F.inline("edits")).select("first_at", F.posexplode("made").alias("n", "made")).where("made <> ''")
    return rows.join(made.select((F.col("first_at") + F.col("n")).alias("at"), "made"), "at").select("conv_id", "at", _line(F.col("made")).alias("lines"))


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs (conv_id, turn, role, text) as they are.  Returns the verdicts (conv_id,
    counts, cost, audit) and the repaired rows (conv_id, turn from 0, role, text)."""
    plain = damaged(turns.limit(0)).unionByName(turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped")))
    store = Store(turns.sparkSession)
    rows = store.keep(placed(plain))
    verdicts = store.keep(judged(rows))
    out = written(rows, verdicts).select("conv_id", "at", F.posexplode("lines").alias("n", "line"))
    return verdicts.drop("edits"), out.select("conv_id", "at", "n", "line.role", "line.text")


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's verdict (at -1) comes first, then its rows in order."""
    schema = pa.schema([*(_VERDICT.field(n) for n in NAMES), ("repaired_sha256", pa.string())])
    verdict, digest, between = None, None, b""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["at"] < 0:
                if verdict is not None:
                    out.append(verdict | {"repaired_sha256": digest.hexdigest()})
                verdict, digest, between = {n: row[n] for n in NAMES}, hashlib.sha256(), b""
            else:
                digest.update(between + row["line"].encode("utf-8", "surrogatepass"))
                between = b"\n"
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if verdict is not None:
        yield pa.RecordBatch.from_pylist([verdict | {"repaired_sha256": digest.hexdigest()}], schema=schema)


def op11_query(spark, sf_dir: str) -> DataFrame:
    store = Store(spark)
    rows = store.keep(placed(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
    verdicts = store.keep(judged(rows))
    lines = written(rows, verdicts).select("conv_id", "at", F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("line"))
    both = verdicts.select(*NAMES, F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("line")).unionByName(lines, allowMissingColumns=True)
    ordered = both.repartition(shuffle_width(rows), "conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(_digest, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _op11_sql() -> str:
    """The same rows by dynamic programming over (cost, audit, lines) of each state."""
    add = lambda s, cost, letter, lines: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': list_concat({s}.t, [{lines}])}} END"
    more = f"{TRUNCATED} * (fault = 't')::INT"
    gone = lambda q: add(f"s{q}", DELETE, "D", "")
    kept = lambda q, r: f"CASE WHEN fault IN ('', 't') AND r = '{r}' THEN {add(f's{q}', f'{KEEP} + {more}', 'K', 'role || chr(58) || text')} END"
    new = lambda q, role: f"CASE WHEN fault IN ('', 't') THEN {add(f's{q}', f'{REROLE} + {more}', 'R', f'{chr(39)}{role}:{chr(39)} || text')} END"
    put = lambda s, role: add(s, INSERT, "I", f"'{role}:'")
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
harmed AS MATERIALIZED (
  SELECT keyed.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS harm FROM keyed, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM harmed JOIN (VALUES (1), (2)) AS copies(n) ON n = 1 OR harm = 3 WHERE harm <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM damaged),
rows_ AS MATERIALIZED (
  SELECT *, left(role, 1) AS r, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM ordered),
convs AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[]) AS s1,
    {{'c': 5, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM convs
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, list_min([n3, {put("m2", "assistant")}])
  FROM (SELECT *, list_min([n2, {put("n0", "user")}, {put("n1", "user")}, {put("n3", "user")}]) AS m2
    FROM (SELECT w.conv_id, f.i, {gone(0)} AS n0, list_min([{gone(1)}, {kept(0, "s")}]) AS n1,
        list_min([{gone(2)}, {", ".join(f"{kept(q, 'u')}, {new(q, 'user')}" for q in (0, 1, 3))}]) AS n2,
        list_min([{gone(3)}, {kept(2, "a")}, {new(2, "assistant")}]) AS n3
      FROM paths w JOIN rows_ f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
best AS (SELECT conv_id, list_min([s0, s3]) AS x FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated
  FROM rows_ GROUP BY conv_id),
beside AS (SELECT conv_id, r, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before, lag(i) OVER (PARTITION BY conv_id ORDER BY i) AS j FROM rows_),
wrong AS (SELECT conv_id, count(*) AS illegal FROM beside WHERE j IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au') GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(array_to_string(x.t, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""


OP11_SQL = _op11_sql()
