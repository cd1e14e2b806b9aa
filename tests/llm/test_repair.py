"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from siftstone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, dropped int, `at` int"
LEADS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def harmed(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, mine = zlib.crc32(key.encode()) % 20, out[conv]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        mine += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def cheapest(rows):
    """Dijkstra over (cost, audit): the first end taken off the heap is the answer."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(lines)
        letter, to = LEADS[q]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*lines, FULL[letter] + ":")))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (q, role[:1]) in READS:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, READS[q, role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*lines, f"{FULL[letter]}:{text}")))


def expected(rows):
    out = {}
    for conv, mine in harmed(rows).items():
        seen, marked = set(), []
        for _, role, text in mine:
            letters = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((fault, role, text))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, lines = cheapest(marked)
        first = [(r[:1] or "x") for _, r, _ in mine]
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for f, _, _ in marked) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def ran(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return {r.conv_id: tuple(r) for r in repair.op11_query(spark, str(folder)).collect()}


def test_tape_equals_search_over_all_edits():
    rng, machine = random.Random(3), repair.Machine()
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for n in range(6000):
        tape = "".join(rng.choice("ssuuuaaaxSUAX0567" if n % 2 else "suaSUA4") for _ in range(rng.randint(0, 9)))
        rows = [("blank" if x in "0123" else "duplicate" if x in "4567" else "truncated" if x.isupper() else "", names["suax"[repair.TAPE.index(x) % 4]], "t") for x in tape]
        cost, audit, lines = cheapest(rows)
        got = machine.read(tape)
        assert got[:2] == (cost, audit), tape
        made = [{"u": "user:", "a": "assistant:", "U": "user:t", "A": "assistant:t"}.get(c, f"{rows[i][1]}:t") for i, x in enumerate(got[2]) for c in x]
        assert "\n".join(made) == lines, tape
    before = len(machine.vectors)
    for _ in range(20):
        machine.read("".join(rng.choice(repair.TAPE) for _ in range(3000)))
    assert len(machine.vectors) < 200 and before > 10  # finite, however long


def test_query_equals_brute_force(spark, tmp_path):
    rng, rows = random.Random(8), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "Ünder"]
    texts = ["Yes.", "No", "Why?", "", " \t", None, "é…", "Long. text", "a\nb!", "ok . "]
    for conv in range(120):
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, None if rng.random() < 0.03 else turn * (1 + (rng.random() < 0.1)), rng.choice(roles[: 5 if conv % 2 else 10]), rng.choice(texts), 1, 2))
    rows += [(None, None, "user", "hm.", 0, 0), (None, 3, "assistant", "hm.", 0, 0), (None, None, "user", "hm.", 0, 0), *rows[5:9]]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "never seen", 0, 0), (3000, 0, "user", "x" * 300_000 + ".", 0, 0), (3000, 1, "assistant", "word " * 100_000, 0, 0)]
    got, want = ran(spark, tmp_path, rows), expected(rows)
    assert got == want and len(got) == 123
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_over_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Good.", f"n {i}.", "cut", ""]), 0, 0) for i in range(4000)]
    rows += [(i, 0, "user", "same start.", 0, 0) for i in range(100, 900)]
    placed = repair.placed(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    assert placed.where("conv_id = 7").selectExpr("shiftright(at, 33) as piece").distinct().count() > 2
    assert ran(spark, tmp_path, rows) == expected(rows)


def test_empty_table_and_repaired_rows(spark, tmp_path):
    assert ran(spark, tmp_path, []) == {}
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", 0, 0), (1, 1, "user", "There?", 0, 0), (1, 2, "user", None, 0, 0), (2, 0, "system", "Be brief.", 0, 0)], SCHEMA)
    verdicts, rows = repair.repair_conversations(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in verdicts.collect()} == {1: (3, "KRD"), 2: (2, "D")}
    assert [tuple(r) for r in rows.orderBy("conv_id", "at", "n").select("conv_id", "role", "text").collect()] == [(1, "user", "Hi."), (1, "assistant", "There?")]
