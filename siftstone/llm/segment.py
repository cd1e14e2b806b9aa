"""SentencePiece encoding by Gumbel top-k sampling without replacement.

A text's segmentations are the paths of a lattice: an edge is a vocabulary
piece that stands at that place, or the bytes of a character without a piece.
Pieces have the weight 1 / (rank + OFFSET), by rank in the vocabulary (a Zipf
law; the file's own scores are ranks, not probabilities), and a path the
product of its edges' weights.  Perturbing every path's log probability with
Gumbel noise and taking the k largest gives k distinct segmentations, a sample
without replacement.  A best-first (A*) search finds them without listing
paths: a set of paths with probability mass m has its largest perturbed value
at Gumbel(log m), and below a set with value g the best child keeps g while the
rest gets a Gumbel truncated at g.  So the frontier is, along every path found,
one set of not taken siblings a step; the largest is taken off, one of its
edges is chosen by mass, and the rest of the path follows by sampling.

No piece has a space after another character, so a word with the spaces before
it is a lattice of its own, and the masses behind any place of it come from a
backward sum that is made once for each distinct word and kept by the worker
(bounded; when full, and after a task, the words that came most often stay).  All
words of a chunk take their steps together.

``log_inclusion`` is the log chance that the segmentation enters the sample
given the value that the (k+1)-th would have.  Random numbers are functions of
the row's key (its id, or a column that is named), the sample's number and the
place in the text only.

Decoding joins the pieces, spaces for their marks and bytes for byte pieces,
and drops the space that encoding put in front.

Rows: U+2581 in a text is taken for a space, as the vocabulary has it stand for
one, so such texts do not come back as they were (``round_trip`` is false); a
null text is empty; an empty text has the one segmentation of the
leading space; texts with fewer than k segmentations give fewer rows; repeated
rows give equal rows; a null key counts as 0.  An empty table gives an empty
result.  Texts are cut whole, however long, word by word, so that a lattice is no longer
than a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, table
from .textbatch import U64, Numbered, chunks, end_task, hash_spans, mix, ranges
from .tokens import public_path

K = 2
OFFSET = 2.7
MARK = "▁"
#: Edges that a worker keeps during a task, and from one task to the next.
CACHED_EDGES, KEPT_EDGES = 4_000_000, 1_000_000
#: Bytes of text that are sampled at once; a worker's temporary arrays are some hundred times as large.
CHUNK = 1 << 18


class Vocabulary:
    """Pieces of a SentencePiece file as a trie in arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.byte = {}
        pieces = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[p] = i
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a space; words would not be lattices of their own")
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        rank = {i: k for k, i in enumerate(sorted(pieces.values(), key=lambda i: -sp.get_score(i)))}
        self.weight = np.full(n, -np.log(n + OFFSET))
        for i, k in rank.items():
            self.weight[i] = -np.log(k + OFFSET)
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for p, i in pieces.items():
            at = 0
            for c in p:
                at = nodes.setdefault((at, ord(c)), len(piece_at))
                if at == len(piece_at):
                    piece_at.append(-1)
            piece_at[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        # An open hash table: probing arrays is cheaper than a binary search.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        for k, slot, c in zip(keys.tolist(), self.slot(keys).tolist(), nodes.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.child[slot] = k, c
        self.piece_at = np.array(piece_at, np.int64)
        raw = [b""] * n
        for p, i in pieces.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw_first = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each trie node by a code point, or -1."""
        key = (node << 21) | char
        slot = self.slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.child[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, list[int]]:
        """UTF-8 of what rows of ids (one after the other) stand for, still with
        the space in front, and where each row begins."""
        n = self.raw_first[ids + 1] - self.raw_first[ids]
        return self.raw[ranges(self.raw_first[ids], n)].tobytes(), np.concatenate(([0], np.cumsum(n)))[bounds].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids stand for."""
        out, _ = self.spell(ids, np.array([0, len(ids)]))
        return out[1:] if out[:1] == b" " else out


class Growing:
    """An array that grows at its end without copying all of it each time."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            data = np.zeros(max(len(self.data) * 3 // 2, self.n + len(more)), self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


class Lattices:
    """Lattices of distinct words: nodes are places, edges sorted by node with
    their share (``p``), next node (-1 at the word's end) and id."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number, self.seen = Numbered(), np.zeros(0, np.int64)
        self.held = {name: Growing(kind) for name, kind in (("root", np.int32), ("first", np.int32), ("p", np.float64), ("next", np.int32), ("id", np.int32), ("spelt", np.int32), ("spelt_first", np.int32))}
        for name in ("first", "spelt_first"):
            self.held[name].add(np.zeros(1, np.int32))
        self.publish()

    def end_task(self) -> None:
        """Idle workers share the machine with what runs next."""
        if len(self.p) > KEPT_EDGES:
            self.forget()
        end_task()

    def forget(self) -> None:
        """Keep the words that came most often, with ``KEPT_EDGES`` edges at most."""
        ends = np.append(self.root[1:], len(self.first) - 1)
        edges = (self.first[ends] - self.first[self.root]).astype(np.int64)
        least = 2
        while edges[self.seen >= least].sum() > KEPT_EDGES:
            least *= 2
        keep = np.flatnonzero(self.seen >= least)
        words = list(self.number)
        words = [words[k] for k in keep.tolist()]
        root, size, edges = self.root[keep].astype(np.int64), (ends - self.root)[keep].astype(np.int64), edges[keep]
        node, edge = ranges(root, size), ranges(self.first[root], edges)
        out = self.first[node + 1] - self.first[node]
        moved = np.cumsum(size) - size
        next_ = self.next[edge]
        next_ = np.where(next_ < 0, -1, next_ + np.repeat(moved - root, edges))
        id_, p = self.id[edge].astype(np.int64), self.p[edge].copy()
        spelled = np.flatnonzero(id_ < 0)
        k = -1 - id_[spelled]
        many = (self.spelt_first[k + 1] - self.spelt_first[k]).astype(np.int64)
        spelt = self.spelt[ranges(self.spelt_first[k], many)]
        id_[spelled] = -1 - np.arange(len(spelled))
        self.clear()
        self.number.update((w, i) for i, w in enumerate(words))
        self.seen = np.ones(len(words), np.int64)
        for name, x in (("root", moved), ("first", np.cumsum(out)), ("p", p), ("next", next_), ("id", id_), ("spelt", spelt), ("spelt_first", np.cumsum(many))):
            self.held[name].add(x)
        self.publish()

    def publish(self) -> None:
        self.root, self.first, self.p, self.next, self.id, self.spelt, self.spelt_first = (x.all() for x in self.held.values())

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many each text has; learns new ones."""
        if len(self.p) > CACHED_EDGES:
            self.forget()
        buf, start, end, sizes = words_of(texts)
        out, at = self.number.number(hash_spans(buf, start, end))
        seen = np.bincount(out, minlength=len(self.number))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        if len(at):
            raw = memoryview(buf)
            self.learn([str(raw[a:b], "utf-8") for a, b in zip(start[at].tolist(), end[at].tolist())])
        return out, sizes

    def learn(self, words: list[str]) -> None:
        v = self.vocabulary
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        char[char == 32] = ord(MARK)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        end = np.repeat(start + size, size)
        at = np.arange(len(char))
        node, src, length, piece = np.zeros(len(char), np.int64), [], [], []
        place, step = at, 0
        while len(place):
            node = v.step(node, char[place + step])
            ok = node >= 0
            place, node = place[ok], node[ok]
            hit = v.piece_at[node] >= 0
            src.append(place[hit])
            length.append(np.full(int(hit.sum()), step + 1))
            piece.append(v.piece_at[node[hit]])
            step += 1
            ok = place + step < end[place]
            place, node = place[ok], node[ok]
        # A character without a piece of its own is its bytes.
        bare = np.ones(len(char), bool)
        bare[src[0] if src else []] = False
        bare = np.flatnonzero(bare)
        src, length, piece = (np.concatenate([*x[::-1], y]) for x, y in ((src, bare), (length, np.ones(len(bare), np.int64)), (piece, -1 - char[bare])))
        order = np.argsort(src, kind="stable")  # longer pieces, mostly the likelier ones, come first already
        src, length, piece = src[order], length[order], piece[order]
        many = np.ones(len(src), np.int64)
        spelled = np.flatnonzero(piece < 0)
        raw = [[v.byte[b] for b in chr(-1 - c).encode()] for c in piece[spelled].tolist()]
        many[spelled] = [len(r) for r in raw]
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], many * v.weight[v.byte[0]])
        # Backward sums, by distance from the word's end.
        word = np.repeat(np.arange(len(words)), size)
        here, there = src + word[src], src + word[src] + length
        back = np.zeros(len(char) + len(words))
        far = end[src] - src
        by = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        cut = np.concatenate(([0], np.flatnonzero(np.diff(far[by])) + 1, [len(by)])) if len(by) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            e = by[a:b]
            x, s = weight[e] + back[there[e]], here[e]
            head = np.flatnonzero(np.diff(s, prepend=-1))
            top = np.maximum.reduceat(x, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(s))))
            back[s[head]] = top + np.log(np.add.reduceat(np.exp(x - top[group]), head))
        log = np.minimum(weight + back[there] - back[here], 0.0)
        p = np.exp(log)
        nodes = len(back)
        first = np.searchsorted(here, np.arange(nodes + 1))
        # An edge's id, or below zero the number of its byte spelling.
        edges, base, spelt = len(self.p), len(self.first) - 1, len(self.spelt_first) - 1
        ids = piece.copy()
        ids[spelled] = -1 - spelt - np.arange(len(spelled))
        flat = np.array([b for r in raw for b in r], np.int32)
        bounds = len(self.spelt) + np.cumsum(many[spelled])
        for name, x in (("root", base + start + np.arange(len(words))), ("first", edges + first[1:]), ("p", p), ("next", np.where(length == end[src] - src, -1, base + there)), ("id", ids), ("spelt", flat), ("spelt_first", bounds)):
            self.held[name].add(x)
        self.publish()

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its word's end, every edge by its share: edges of
        all walks one after the other, and each walk's length.  ``key`` seeds
        each walk."""
        n = np.zeros(len(node), np.int64)
        taken, step = [], 0
        live = np.flatnonzero(node >= 0)
        node = node[live]
        while len(live):
            with np.errstate(over="ignore"):
                u = uniform(key[live] + U64(step) * U64(0x9E3779B97F4A7C15))
            e = self.first[node]
            u -= self.p[e]
            more = np.flatnonzero(u > 0)
            last = self.first[node[more] + 1] - 1
            while len(more):
                ok = e[more] < last  # the last edge takes what rounding leaves
                more, last = more[ok], last[ok]
                e[more] += 1
                u[more] -= self.p[e[more]]
                ok = u[more] > 0
                more, last = more[ok], last[ok]
            taken.append((live, e))
            n[live] += 1
            node = self.next[e]
            step += 1
            open_ = np.flatnonzero(node >= 0)
            live, node = live[open_], node[open_]
        out = np.zeros(int(n.sum()), np.int64)
        at = np.cumsum(n) - n
        for step, (walks, edges) in enumerate(taken):
            out[at[walks] + step] = edges
        return out, n


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from counters."""
    return ((mix(x) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, each with a space in front and spaces for marks; the
    bounds of their words; and how many words each text has.  A word is a line
    feed, or spaces and what follows them up to the next space or line feed."""
    raw = [(" " + t.replace(MARK, " ")).encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    space, feed = buf == 32, buf == 10
    starts = feed | space
    starts[1:] &= feed[1:] | ~space[:-1]
    starts[1:] |= feed[:-1]
    starts[first[:-1]] = True
    start = np.flatnonzero(starts)
    return buf, start, np.append(start[1:], len(buf)), np.diff(np.searchsorted(start, first))


def truncated(log_mass: np.ndarray, below: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel(log_mass) given that it is less than ``below``."""
    return -np.logaddexp(-below, np.log(-np.log(u)) - log_mass)


class _Found:
    """A path found for a text: its edges from step ``start`` on (before that it
    is its parent's), the words of these steps, and the frontier along them:
    the log mass before each step and the bound of its not taken siblings."""

    __slots__ = ("parent", "start", "edges", "units", "upto", "bound", "barred", "value", "log")

    def __init__(self, parent, start, edges, units, upto, bound, value, log, barred):
        self.parent, self.start, self.edges, self.units, self.upto, self.bound, self.value, self.log = parent, start, edges, units, upto, bound, value, log
        self.barred = {} if barred is None else {0: barred}

    def path(self, until: int | None = None) -> np.ndarray:
        own = self.edges if until is None else self.edges[: max(0, until - self.start)]
        return own if self.parent is None else np.concatenate((self.parent.path(self.start if until is None else min(until, self.start)), own))


def sample(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int = K) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its sample: (edges, log probability, perturbed value, log
    inclusion), best first."""
    words, sizes = lattices.read(texts)
    first = np.concatenate(([0], np.cumsum(sizes)))
    with np.errstate(over="ignore"):
        seed = mix(keys.astype(np.int64).view(U64) ^ U64(0xA0761D6478BD642F))
        lane = lambda doc, turn: mix(seed[doc] + U64(turn + 1) * U64(0xD6E8FEB86659FD93))
        lane_of = lambda doc, unit, turn: mix(lane(doc, turn) + unit.astype(U64) * U64(0xE7037ED1A0B428DB))

    def walk_all(docs: np.ndarray, unit: np.ndarray, node: np.ndarray, turn: int):
        # From the given node of the given word to the end of each text.
        tail = sizes[docs] - unit - 1
        doc = np.repeat(docs, tail + 1)
        u = ranges(unit, tail + 1)
        nodes = lattices.root[words[first[doc] + u]]
        nodes[np.cumsum(tail + 1) - tail - 1] = node
        with np.errstate(over="ignore"):
            key = lane_of(doc, u, turn)
        edges, n = lattices.walk(nodes, key)
        units = np.repeat(u, n)
        ends = np.cumsum(np.add.reduceat(n, np.cumsum(tail + 1) - tail - 1)) if len(n) else np.zeros(0, np.int64)
        return edges, units, np.concatenate(([0], ends))

    def along(who, turn: int, parents, starts, before, values, edges, units, ends, barred) -> list[_Found]:
        # Masses and bounds of all new paths at once.
        size = np.diff(ends)
        owner = np.repeat(np.arange(len(who)), size)
        p = lattices.p[edges]
        total = np.concatenate(([0.0], np.cumsum(np.log(p))))
        upto = total[:-1] - (total[ends[:-1]] - before)[owner]
        logs = before + total[ends[1:]] - total[ends[:-1]]
        rest = 1.0 - p
        rest[p >= 1.0 - 1e-12] = 0.0
        for i, taken in enumerate(barred):
            if taken is not None:  # of the set that was taken off, what remains beside this edge
                first_edge, last_edge, out = taken
                left = 1.0 - lattices.p[out].sum()
                rest[ends[i]] = left if left > 1e-12 and len(out) < last_edge - first_edge else 0.0
        open_ = np.flatnonzero(rest)
        by = owner[open_]
        with np.errstate(over="ignore"):
            u = uniform((lane(who, turn) ^ U64(0x1D8E4E27C47D124F))[by] + (open_ + (starts - ends[:-1])[by]).astype(U64) * U64(0xEB44ACCAB455D165))
        bound = np.full(len(edges), -np.inf)
        bound[open_] = truncated(upto[open_] + np.log(rest[open_]), values[by], u)
        return [_Found(parents[i], int(starts[i]), edges[a:b], units[a:b], upto[a:b], bound[a:b], float(values[i]), float(logs[i]), None if barred[i] is None else barred[i][2])
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist()))]

    docs = np.arange(len(texts))
    edges, units, ends = walk_all(docs, np.zeros(len(docs), np.int64), lattices.root[words[first[:-1]]], 0)
    top = -np.log(-np.log(uniform(seed)))
    zero = np.zeros(len(docs))
    found = [[x] for x in along(docs, 0, [None] * len(docs), zero.astype(np.int64), zero, top, edges, units, ends, [None] * len(docs))]
    last = np.full(len(texts), -np.inf)
    for turn in range(1, k + 1):
        picks = []
        for d, paths in enumerate(found):
            if len(paths) < turn:
                continue
            best, at = max(((float(p.bound.max()), p) for p in paths if len(p.bound)), key=lambda x: x[0], default=(-np.inf, None))
            if turn == k or at is None or np.isneginf(best):
                last[d] = max(last[d], best)
                continue
            step = int(at.bound.argmax())
            e = int(at.edges[step])
            node = int(np.searchsorted(lattices.first, np.int32(e), side="right")) - 1
            a, b = int(lattices.first[node]), int(lattices.first[node + 1])
            out = at.barred.get(step, [e])
            share = lattices.p[a:b].copy()
            share[np.array(out) - a] = 0.0
            running = np.cumsum(share)
            with np.errstate(over="ignore"):
                u = float(uniform(lane(np.array([d]), turn) ^ U64(0x589965CC75374CC3))[0])
            choice = a + min(int(np.searchsorted(running, u * running[-1], side="right")), int(np.flatnonzero(share)[-1]))
            at.bound[step] = -np.inf
            picks.append((d, at, step, choice, best, (a, b, [*out, choice])))
        if not picks:
            continue
        who, parents, steps, choices, values, barred = zip(*picks)
        who, choices = np.array(who), np.array(choices)
        unit = np.array([int(x.units[k]) for x, k in zip(parents, steps)])
        edges, units, ends = walk_all(who, unit, lattices.next[choices], turn)
        edges, units = np.insert(edges, ends[:-1], choices), np.insert(units, ends[:-1], unit)
        ends = ends + np.arange(len(ends))
        starts = np.array([x.start + k for x, k in zip(parents, steps)])
        before = np.array([float(x.upto[k]) for x, k in zip(parents, steps)])
        for d, x in zip(who.tolist(), along(who, turn, parents, starts, before, np.array(values), edges, units, ends, barred)):
            found[d].append(x)
    out = []
    for d, paths in enumerate(found):
        rows = []
        for p in paths:
            gap = p.log - last[d]
            rows.append((p.path(), p.log, p.value, 0.0 if gap > 30 else gap if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))))
        out.append(rows)
    return out


def edge_ids(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    ids = lattices.id[edges].astype(np.int64)
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids
    k = -1 - ids[spelled]
    many = np.ones(len(ids), np.int64)
    many[spelled] = lattices.spelt_first[k + 1] - lattices.spelt_first[k]
    out = np.repeat(ids, many)
    out[out < 0] = lattices.spelt[ranges(lattices.spelt_first[k], many[spelled])]
    return out


def ids_of(paths: list[np.ndarray], lattices: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all paths one after the other, and where each begins."""
    flat = np.concatenate(paths) if paths else np.zeros(0, np.int64)
    code = lattices.id[flat].astype(np.int64)
    many = np.ones(len(flat), np.int64)
    k = -1 - code[code < 0]
    many[code < 0] = lattices.spelt_first[k + 1] - lattices.spelt_first[k]
    total = np.concatenate(([0], np.cumsum(many)))
    return edge_ids(lattices, flat), total[np.concatenate(([0], np.cumsum([len(p) for p in paths], dtype=np.int64)))]


_lattices: dict[str, Lattices] = {}


def lattices_of(path: str) -> Lattices:
    """This worker's lattices; they outlive a task."""
    if path not in _lattices:
        _lattices[path] = Lattices(Vocabulary(path))
    return _lattices[path]


def _sample(path: str, k: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                keys, texts, seeds = part.column(0), [t or "" for t in part.column(1).to_pylist()], part.column(2)
                rows = {x: [] for x in ("key", "seed", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids", "ids_crc32", "round_trip")}
                got = sample(lattices, texts, np.asarray(seeds.fill_null(0), np.int64), k)
                all_ids, bounds = ids_of([f[0] for found in got for f in found], lattices)
                narrow = all_ids.astype("<i4")
                if digest:
                    raw, spelt = lattices.vocabulary.spell(all_ids, bounds)
                place = 0
                for key, seed, text, found in zip(keys.to_pylist(), seeds.to_pylist(), texts, got):
                    plain = text.encode() if digest else b""
                    for i, (_, log, value, inclusion) in enumerate(found):
                        a, b = int(bounds[place]), int(bounds[place + 1])
                        for name, x in zip(rows, (key, seed, i, b - a, log, value, inclusion)):
                            rows[name].append(x)
                        if digest:
                            rows["ids_crc32"].append(zlib.crc32(narrow[a:b]))
                            rows["round_trip"].append(raw[spelt[place] + 1 : spelt[place + 1]] == plain)
                        place += 1
                kinds = {"key": pa.int64(), "seed": pa.int64(), "sample": pa.int32(), "n_pieces": pa.int64(), "log_prob": pa.float64(), "perturbed": pa.float64(), "log_inclusion": pa.float64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64(), "round_trip": pa.bool_()}
                names = [n for n in rows if digest or n not in ("ids_crc32", "round_trip")]
                # The ids of all rows lie one after the other already.
                held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(narrow))
                yield pa.RecordBatch.from_arrays([held if n == "ids" else pa.array(rows[n], kinds[n]) for n in names], names)
        lattices.end_task()

    return run


_BASE = "key long, seed long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids array<int>"


def sample_segmentations(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k: int = K, digest: bool = False, seed_col: str | None = None) -> DataFrame:
    """Rows (id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids), up
    to k a document, in order of ``perturbed``; with ``digest`` also the ids'
    crc32 and whether decoding gives the text back.  The id seeds a row's random
    numbers, or else the column ``seed_col``, which then follows the id."""
    slim = docs.select(col(id_col).cast("long").alias("key"), col(text_col).alias("text"), col(seed_col or id_col).cast("long").alias("seed"))
    out = slim.mapInArrow(_sample(path, k, digest), _BASE + (", ids_crc32 long, round_trip boolean" if digest else ""))
    out = out.withColumnRenamed("seed", seed_col) if seed_col else out.drop("seed")
    return out.withColumnRenamed("key", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``text``, what the ids stand for; null for null ids."""
    base = rows.drop("text")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattices_of(path).vocabulary
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            text = [None if x is None else vocabulary.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*names, "text"])

    return base.mapInArrow(run, base.withColumn("text", F.lit(None).cast("string")).schema)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_segmentations(docs, public_path("piece_bpe_32k.model"), digest=True)
