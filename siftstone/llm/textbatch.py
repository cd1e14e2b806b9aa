"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  UTF-8
continuation bytes never fall in that set, so words may be found on bytes.
All functions work on a chunk of whole texts held in one byte buffer; a chunk
is bounded in bytes unless a single text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the hashes (any odd 64-bit numbers do).
LANE_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of a word that are hashed eight at a time; longer ones go to XXH64.
SHORT = 32
WORD_BASE = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
#: Most bytes of text handled at once; a longer single text forms its own chunk.
CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    sizes = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def text_bytes(col: pa.Array) -> np.ndarray:
    """UTF-8 length of each text; 0 for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of a chunk: byte bounds ``start``/``end`` and ``first[d]``, the
    index of the first word of text ``d`` (``first`` has one more entry)."""

    def __init__(self, col: pa.Array):
        self.buf, self.offs = buffer_of(col)
        n = len(self.buf)
        gap = np.empty(n + 1, bool)
        gap[:n] = (self.buf == 32) | ((self.buf - np.uint8(9)) <= 4)
        gap[n] = True
        edge = np.zeros(n + 1, bool)
        edge[self.offs] = True
        word = ~gap[:n]
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = gap[: n - 1]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        self.end = np.flatnonzero(word & (gap[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offs)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts())

    def hashes(self, which: int = 0) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end, which)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: of its length and its bytes, eight
    at a time, each step a bijection of what came before."""
    size = end - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    base = U64(LANE_BASE[which])
    out = mix(size.astype(U64) * base)
    todo = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        lane = lanes[start[todo] + at] & _MASKS[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ lane) * base)
    rest = np.flatnonzero(size > SHORT)
    if len(rest):
        import xxhash

        raw = memoryview(padded)
        out[rest] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], which) for a, b in zip(start[rest].tolist(), end[rest].tolist())), U64, len(rest))
    return out


class Numbered(dict):
    """Gives every hash that it has not met the next number."""

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all, and for each new number the place where it came."""
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.fromiter(map(self.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        new = new[np.argsort(at[new])]
        known[new] = len(self) + np.arange(len(new))
        self.update(zip(distinct[new].tolist(), known[new].tolist()))
        return known[which], at[new]


#: Keep the first 0 to 8 bytes of eight.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U64))
        have = both[0], both[1]
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def end_task() -> None:
    """Give back the tables of powers, which a task makes in milliseconds, and the
    memory that Arrow holds for later: idle workers share the machine."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all input bits (SplitMix64's)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def runs_of(word_hash: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words of the chunk (len - k + 1 of
    them, also those that cross from one text into the next)."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, U64)
    power, inverse = powers(WORD_BASE[which], n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(word_hash * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any half-open [start, end)."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth[:n]) > 0


def spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of True."""
    edge = np.diff(np.concatenate(([0], flag.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
