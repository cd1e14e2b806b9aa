"""Token counts by rank-synchronous array merging.

White space separates pre-tokens, so a text's tokens are those of its words,
and equal words have equal tokens.  Each worker keeps the counts of the words
it has met (bounded, emptied when full).  New words are normalised and cut into
pre-tokens by the tokenizer's own first steps; their symbols are then held as
one ragged array.  In every round each sequence finds its lowest-rank adjacent
pair and all sequences merge theirs at once; sequences without a pair leave,
and the symbols they are left with are counted.

All occurrences of the pair in a sequence merge together, left to right, which
equals merging one by one as long as no merge yields a pair of lower rank.
That holds if a merge only joins symbols made by earlier merges; it is checked
when the vocabulary is read, and otherwise only the leftmost pair merges.
A sequence of more than ``LONG`` symbols (an unbroken run of letters; a documented
parameter) makes the same rounds, rank by rank with all places of the lowest one at
once, on another layout: flat arrays of symbols and of links to both neighbours, and
the places of each rank, so that a round costs what it merges and not the whole
sequence.  The counts are those of the ragged layout, which tests compare at the boundary.

Rows: a null text is empty; rows repeat as they come; other columns pass
through.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch
from .common import col, free
from .textbatch import Numbered, chunks, ranges

LIMIT = 2048
#: Symbols beyond which a sequence has links and its places by rank (same rounds, same counts).
LONG = 256
#: Words whose tokens a worker keeps.
CACHED = 500_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merge rules of a BPE file as arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = model.get("unk_token")
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("this kind of BPE is not supported")
        self.base = max(self.vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.base + right
        # Of a pair that is listed twice, the later rank counts, as in a map.
        self.keys, last = np.unique(keys[::-1], return_index=True)
        rank = len(keys) - 1 - last
        self.rank, self.made = rank.astype(np.int64), made[rank]
        self.rank_of = dict(zip(self.keys.tolist(), rank.tolist()))
        self.made_by_rank = made.tolist()
        maker = np.full(self.base, -1, np.int64)
        np.maximum.at(maker, made, np.arange(len(made)))
        self.ordered = bool((np.maximum(maker[left], maker[right]) < np.arange(len(made))).all())
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("this kind of added token is not supported")

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the rules, or -1."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != key] = -1
        return at

    def symbols(self, piece: str) -> list[int]:
        """First symbols of one pre-token; the last carries the word end.
        Characters that the vocabulary lacks are left out, as the library does
        where no unknown token is named."""
        known = [self.vocab.get(c) for c in piece[:-1]] + [self.vocab.get(piece[-1] + self.suffix)]
        if self.unknown is not None and None in known:
            raise ValueError(f"a character of {piece[:20]!r} is not in the vocabulary; unknown tokens are not supported")
        return [x for x in known if x is not None]

    def count_long(self, sequence: list[int]) -> int:
        """Symbols left of one sequence, in rounds by rank: each merges all
        places of the lowest rank that is left (only the leftmost, where a merge
        may yield a pair of lower rank)."""
        symbol, n, base, rank_of = list(sequence), len(sequence), self.base, self.rank_of
        following, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        own = array("q", (rank_of.get(a * base + b, -1) for a, b in zip(symbol, symbol[1:])))
        own.append(-1)
        places: dict[int, list[int]] = {}
        for i, r in enumerate(own):
            if r >= 0:
                places.setdefault(r, []).append(i)
        ranks, left = list(places), n
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            todo = sorted(places.pop(rank))
            for k, i in enumerate(todo):
                if own[i] != rank:
                    continue
                gone = following[i]
                symbol[i], after = self.made_by_rank[rank], following[gone]
                following[i], own[gone] = after, -1
                left -= 1
                if after < n:
                    before[after] = i
                for a in (before[i], i):
                    if a < 0:
                        continue
                    b = following[a]
                    own[a] = new = rank_of.get(symbol[a] * base + symbol[b], -1) if b < n else -1
                    if new >= 0:
                        if new not in places:
                            places[new] = []
                            heappush(ranks, new)
                        places[new].append(a)
                if not self.ordered:
                    if k + 1 < len(todo):
                        if rank not in places:
                            places[rank] = []
                            heappush(ranks, rank)
                        places[rank] += todo[k + 1 :]
                    break
        return left

    def count_symbols(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        long = {i: self.count_long(s) for i, s in enumerate(sequences) if len(s) > LONG}
        sequences = [[] if i in long else s for i, s in enumerate(sequences)] if long else sequences
        sizes = np.array([len(s) for s in sequences], np.int64)
        left = sizes.copy()
        left[list(long)] = list(long.values())
        flat = np.fromiter((x for s in sequences for x in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        none = len(self.keys) + len(self.rank)
        while len(flat) > 1:
            at = self.find(flat[:-1], flat[1:])
            at[owner[:-1] != owner[1:]] = -1
            rank = np.where(at >= 0, self.rank[at], none)
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            # The place after a sequence's last symbol never has a pair.
            best = np.minimum.reduceat(np.append(rank, none), head)
            mine = np.repeat(best, np.diff(np.append(head, len(flat))))
            hit = np.flatnonzero((rank == mine[:-1]) & (rank < none))
            if not len(hit):
                break
            if self.ordered:
                # Of overlapping pairs (the same symbol again and again) every second one.
                run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[place % 2 == 0]
            else:
                hit = hit[np.diff(owner[hit], prepend=-1) != 0]
            flat[hit] = self.made[at[hit]]
            stay = np.ones(len(flat), bool)
            stay[hit + 1] = False
            left -= np.bincount(owner[hit], minlength=len(left))
            going = best < none
            stay &= np.repeat(going, np.diff(np.append(head, len(flat))))
            flat, owner = flat[stay], owner[stay]
        return left

    def pieces(self, word: str) -> tuple[int, list[str]]:
        """Special tokens in a word, and its pre-tokens."""
        special, parts = 0, [word]
        for s in self.special:
            if s in word:
                cut = [p.split(s) for p in parts]
                special += sum(len(p) - 1 for p in cut)
                parts = [x for p in cut for x in p]
        found = []
        for p in parts:
            if p:
                n = self.tokenizer.normalizer.normalize_str(p) if self.tokenizer.normalizer else p
                found += [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(n) if x]
        return special, found

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        total = np.zeros(len(words), np.int64)
        sequences, owner = [], []
        for i, w in enumerate(words):
            special, found = self.pieces(w.decode("utf-8", "replace"))
            total[i] = special
            for p in found:
                sequences.append(self.symbols(p))
                owner.append(i)
        if sequences:
            total += np.bincount(owner, weights=self.count_symbols(sequences), minlength=len(words)).astype(np.int64)
        return total


class Words:
    """Numbers words (by their hashes) as they come.  Beyond ``limit`` words, those that came
    once since the last time are forgotten."""

    def __init__(self, limit: int = CACHED):
        self.limit = limit
        self.number = Numbered()
        self.seen = np.zeros(0, np.int64)

    def read(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray | None]:
        """Word numbers of all texts, words of each text, new words (numbered
        after those before), and None or the old numbers of the words that
        were kept, which are numbered from 0 again."""
        kept = None
        if len(self.number) > self.limit:
            least = 2
            kept = np.flatnonzero(self.seen >= least)
            while len(kept) > self.limit // 2:
                least *= 2
                kept = np.flatnonzero(self.seen >= least)
            words = list(self.number)
            self.number = Numbered()
            self.number.update((words[k], i) for i, k in enumerate(kept.tolist()))
            self.seen = np.ones(len(kept), np.int64)
        words = textbatch.Words(batch)
        index, at = self.number.number(words.hashes())
        raw = memoryview(words.buf)
        new = [bytes(raw[a:b]) for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
        seen = np.bincount(index, minlength=len(self.number))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        return index, words.counts(), new, kept


def rows_of(first: np.ndarray, flat: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ragged rows the given ones: their bounds and values."""
    n = (first[1:] - first[:-1])[keep]
    return np.concatenate(([0], np.cumsum(n))), flat[ranges(first[:-1][keep], n)]


_counters: dict[str, tuple[Merges, Words, list]] = {}


def count_texts(path: str, batch: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    if path not in _counters:
        _counters[path] = Merges(path), Words(), [np.zeros(0, np.int64)]
    merges, words, kept = _counters[path]
    index, sizes, new, keep = words.read(batch)
    if keep is not None:
        kept[0] = kept[0][keep]
    if new:
        kept[0] = np.concatenate((kept[0], merges.count_words(new)))
    total = np.concatenate(([0], np.cumsum(kept[0][index])))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return total[ends[1:]] - total[ends[:-1]]


def _count(text: str, names: list[str], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                yield pa.RecordBatch.from_arrays([*(get(x) for x in names), pa.array(count_texts(path, get(text)))], [*names, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; the text
    itself is dropped."""
    base = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = [c for c in base.columns if c != text_col]
    (text,) = free(base, "text_of_row")
    sized = base.select(*(col(c) for c in names), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), col(text_col).alias(text))
    out = sized.drop(text).withColumn("n_tokens", F.lit(0).cast("long")).schema
    return sized.mapInArrow(_count(text, [*names, "n_bytes"], path), out).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("word_bpe_49k.json"))
