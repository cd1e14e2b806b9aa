from __future__ import annotations

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm import segment, tokenfile, tokens
from siftstone.llm.common import Store

BPE = tokens.public_path("word_bpe_49k.json")
PIECES = tokens.public_path("piece_bpe_32k.model")
ODD = ["", "  ", "<|endoftext|>hi<|startoftext|>", "É é x　y can't DON'T it's 12345 \x1c a\x1cb ΣΑΣ İ ​ 🙂🙂 !!!???", None, "a" * 3000, "ab" * 2000, "<|ENDOFTEXT|>", "\x85q z", "日本語 test"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_counts_equal_the_library(docs, rows, library, none):
    for text, n in zip(ODD, tokens.count_texts(BPE, pa.array(ODD)).tolist()):
        assert n == len(library.encode(text or "", add_special_tokens=False).ids), text
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs.select("doc_id", "text"), BPE).collect()), key=repr)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 2048) for r in rows), key=repr)
    assert tokens.count_tokens(none, BPE).count() == 0


def test_both_layouts_count_alike_at_the_boundary(library, monkeypatch):
    rng = random.Random(12)
    near = ["".join(rng.choice("etaoinshrdl") for _ in range(n)) for n in range(tokens.LONG - 6, tokens.LONG + 7)] + ["th" * (tokens.LONG // 2 + d) for d in (-1, 0, 1)] + ["a" * 5000]
    expected = [len(library.encode(w, add_special_tokens=False).ids) for w in near]
    merges = tokens.Merges(BPE)
    sequences = [merges.symbols(w) for w in near]
    for long in (tokens.LONG, 1, 10**9):  # as it is, all linked, all ragged
        monkeypatch.setattr(tokens, "LONG", long)
        assert merges.count_symbols([list(s) for s in sequences]).tolist() == expected


def test_leftmost_merging_gives_the_same():
    merges = tokens.Merges(BPE)
    sequences = [merges.symbols(p) for w in ("aaaaaaa", "internationalisation", "abababab", "zzz") for p in merges.pieces(w)[1]]
    together = merges.count_symbols(sequences)
    assert merges.ordered
    merges.ordered = False
    assert (merges.count_symbols(sequences) == together).all()


def test_long_words_take_time_in_proportion(library):
    rng = random.Random(6)
    merges = tokens.Merges(BPE)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé日") for _ in range(k))
    for text in (letters(257), letters(5000), "a" * 1000 + "ab" * 900, "the" * 700, letters(300) + " " + "na" * 400 + "!" * 600):
        for ordered in (True, False):
            merges.ordered = ordered
            assert merges.count_words([w.encode() for w in text.split()]).sum() == len(library.encode(text, add_special_tokens=False).ids)
    took = []
    for k in (20_000, 80_000):
        began = time.process_time()
        merges.count_words([letters(k).encode()])
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_unknown_characters_are_not_dropped_silently():
    merges = tokens.Merges(BPE)
    merges.unknown = None
    assert merges.symbols("\u4e00") == []  # pre-tokens are byte letters; this is none
    merges.unknown = "<|endoftext|>"
    with pytest.raises(ValueError):
        merges.symbols("\u4e00")


def test_clashing_columns_pass(spark):
    df = spark.createDataFrame([(1, "a cat", 5, 6, "x")], "doc_id long, text string, N_TOKENS long, text_of_row long, over_limit string")
    row = tokens.count_tokens(df, BPE).first()
    assert row.n_tokens == 2 and row.n_bytes == 5 and row.over_limit is False and row.text_of_row == 6


def test_word_cache_is_bounded():
    words = tokens.Words(limit=3)
    index, sizes, new, kept = words.read(pa.array(["a b c d", "a d"]))
    assert new == [b"a", b"b", b"c", b"d"] and index.tolist() == [0, 1, 2, 3, 0, 3] and sizes.tolist() == [4, 2] and kept is None
    words.limit = 3
    index, _, new, kept = words.read(pa.array(["d e", None]))
    assert kept.tolist() == [] or kept.tolist() == [0, 3]
    assert len(words.number) <= 4 and len(index) == 2


def test_small_caches_change_no_result(library):
    texts = pa.array(["the cat sat on the mat", "a dog and the cat", None, "unhappily reunited cats", "the mat the mat"] * 3)
    encoder = tokenfile.Encoder(BPE)
    encoder.words.limit = 4
    for i in range(len(texts)):
        ids, n = encoder.encode(texts.slice(i, 1), 2)
        assert ids.tolist() == [*library.encode(texts[i].as_py() or "", add_special_tokens=False).ids, 2] and n.tolist() == [len(ids)]
    assert len(encoder.words.number) <= 12


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    index = tokenfile.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert len(tokenfile.PerfectHash.build(keys[:0]).slots(keys[:5])) == 5


def test_token_files_round_trip(spark, docs, rows, library, none):
    folder = Store(spark).home
    manifest = tokenfile.write_ids(docs, folder, BPE)
    got = tokenfile.read_records(spark, folder).orderBy("start").collect()
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert [r.key for r in got if r.key is not None] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r.key for r in got[-2:]] == [None, None]
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert sorted((repr(r.key), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(r[0]), len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    by_id = {r[0]: r[1] for r in rows}
    for m in manifest.collect():
        shard = tokenfile.Shard(f"{folder}/{m.file}")
        held = shard.keys[shard.flags]
        assert (shard.keys[shard.lookup(held)] == held).all()
        assert (shard.lookup(np.arange(50_000, 50_400)) == -1).all()
        for k in held[:3].tolist():
            assert (shard.ids(int(shard.lookup(np.array([k]))[0])) == ids(by_id[k])).all()
    empty = Store(spark).home
    assert tokenfile.write_ids(none, empty, BPE).count() == 0 and tokenfile.read_records(spark, empty).count() == 0


def cut_words(text):
    buf, start, end, sizes = segment.words_of([text])
    assert sizes.tolist() == [len(start)]
    return [buf[a:b].tobytes().decode() for a, b in zip(start, end)]


def test_words_of_a_text():
    import re

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("a b\n é☃") for _ in range(rng.randrange(14)))
        assert cut_words(text) == re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text)


def segmentations(lattices, word):
    v = lattices.vocabulary
    word = word.replace(" ", segment.MARK)
    out = []

    def go(at, ids, w):
        if at == len(word):
            out.append((tuple(ids), w))
            return
        node, single = np.zeros(1, np.int64), False
        for end in range(at, len(word)):
            node = v.step(node, np.array([ord(word[end])]))
            if node[0] < 0:
                break
            piece = int(v.piece_at[node[0]])
            if piece >= 0:
                single |= end == at
                go(end + 1, [*ids, piece], w + v.weight[piece])
        if not single:
            raw = [v.byte[b] for b in word[at].encode()]
            go(at + 1, [*ids, *raw], w + len(raw) * v.weight[v.byte[0]])

    go(0, [], 0.0)
    return out


def test_sampling_follows_the_exact_law():
    lattices = segment.lattices_of(PIECES)
    text, n = "ab thé 日\n  x", 6000
    parts = [segmentations(lattices, w) for w in cut_words(text)]
    whole = {sum((c[0] for c in combo), ()): sum(c[1] for c in combo) for combo in itertools.product(*parts)}
    total = math.log(sum(map(math.exp, whole.values())))
    p = {s: math.exp(w - total) for s, w in whole.items()}
    first, second = Counter(), Counter()
    for found in segment.sample(lattices, [text] * n, np.arange(n), 3):
        ids = [tuple(segment.edge_ids(lattices, f[0]).tolist()) for f in found]
        assert len(set(ids)) == 3 and found[0][2] > found[1][2] > found[2][2]
        assert all(abs(math.log(p[i]) - f[1]) < 1e-9 and f[3] <= 0 for i, f in zip(ids, found))
        first[ids[0]] += 1
        second[ids[1]] += 1
    for s in sorted(p, key=p.get, reverse=True)[:4]:
        q = sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)
        for expected, seen in ((p[s], first[s] / n), (q, second[s] / n)):
            assert abs(expected - seen) < 5 * math.sqrt(expected * (1 - expected) / n) + 1e-3


def test_segmentations_decode_to_the_text(spark, docs, rows, none):
    got = segment.sample_segmentations(docs, PIECES, k=2)
    back = segment.decode(got, PIECES)
    texts = Counter((repr(r.doc_id), r.text) for r in back.where("sample = 0").collect())
    assert texts == Counter((repr(r[0]), r[1] or "") for r in rows)
    again = segment.sample_segmentations(docs.repartition(2), PIECES, k=2, digest=True).orderBy("doc_id", "sample").select("doc_id", "ids_crc32", "round_trip").collect()
    once = segment.sample_segmentations(docs, PIECES, k=2, digest=True).orderBy("doc_id", "sample").select("doc_id", "ids_crc32", "round_trip").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, once)) and all(r.round_trip for r in once)
    distinct = got.groupBy("doc_id").agg({"ids": "collect_set"}).collect()
    assert all(len(r[1]) == 2 for r in distinct if r.doc_id in (0, 3, 6))
    assert segment.sample_segmentations(none, PIECES).count() == 0


def test_forgotten_words_change_no_sample(docs, rows, monkeypatch):
    texts = [r[1] or "" for r in rows] + ["日本 é\t☃ 日本", "x" * 90]
    keys = np.arange(len(texts))
    once = segment.Lattices(segment.Vocabulary(PIECES))
    expected = [[segment.edge_ids(once, f[0]).tolist() for f in found] for found in segment.sample(once, texts, keys)]
    monkeypatch.setattr(segment, "KEPT_EDGES", 200)
    monkeypatch.setattr(segment, "CACHED_EDGES", 1500)
    small = segment.Lattices(once.vocabulary)
    for _ in range(2):
        got = []
        for i in range(0, len(texts), 5):
            got += [[segment.edge_ids(small, f[0]).tolist() for f in found] for found in segment.sample(small, texts[i : i + 5], keys[i : i + 5])]
            assert small.number or i == 0
        small.end_task()
        assert len(small.p) <= 200 and got == expected


def test_marks_in_a_text_are_seen_to_be_lost(spark):
    df = spark.createDataFrame([(1, "a\u2581b"), (2, "a b"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.round_trip for r in segment.sample_segmentations(df, PIECES, digest=True).collect()}
    assert got == {1: False, 2: True, None: True}


def test_sentencepiece_ids_decode_alike():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    v = segment.lattices_of(PIECES).vocabulary
    for text in ("", " ", "a  b", "\n a", "日本 é\t☃", "x" * 100):
        assert v.decode(np.array(sp.encode(text), np.int64)) == text.encode()
