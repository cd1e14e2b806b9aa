"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words, and of word beginnings of 4 and 5 letters,
in the whole text.  Logistic regression is fitted on labelled rows; for every
labelled text that names a group, counterfactuals with the identity terms
swapped are made, and the squared change of the text's score is penalised, so
that the mere mention of one group or another moves no score.  Scoring looks
every distinct word up once for each worker and adds the weights of the
features that a text has.

The classifier is fitted on a bounded sample: at most ``max_rows`` labelled
texts, the first by a hash of their id, positives filling at most half; rows
that were not taken are made up for by class weights.  Scoring covers all rows.

Rows: a null or empty text has no features and gets the intercept's score; a
label row with null id or label is unused; repeated rows are each scored.  With
no positive or no negative label the score is the share of positives for all
(0 without labels).  An empty table gives an empty result.  Texts
are scored whole, however long, by the words and word beginnings that they hold.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, col, free, table
from .textbatch import chunks, ranges
from .tokens import Words, rows_of

#: Most labelled texts in the fit.
MAX_ROWS = 16_000
#: Most features of the model besides identity terms, and the least number of
#: training texts that have one.
FEATURES = 1024
LEAST = 4
THRESHOLD = 0.3
RIDGE, FAIRNESS = 2e-4, 1.0
#: Terms for groups of people that may be swapped for each other.
IDENTITY = {
    "religion": "christian muslim jewish hindu buddhist atheist christlich muslimisch jüdisch chrétien musulman juif cristiano musulmán judío".split(),
    "origin": "american african asian european mexican german french spanish turkish arab amerikanisch deutsch américain français español alemán".split(),
    "gender": "women men woman man girls boys trans frauen männer femmes hommes mujeres hombres".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual schwul lesbisch".split(),
    "ability": "deaf blind disabled autistic gehörlos aveugle sourd ciego sordo".split(),
    "age": "elderly young old teenage alte junge vieux jeunes ancianos jóvenes".split(),
}
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def features_of(word: str) -> list[str]:
    """A word's features: each run of letters, and its first 4 and 5."""
    out = []
    for w in _LETTERS.findall(word.lower()):
        out.append(w)
        if len(w) > 4:
            out.append("^" + w[:4])
        if len(w) > 5:
            out.append("^" + w[:5])
    return out


def text_features(text: str | None) -> set[str]:
    return {f for w in set((text or "").split()) for f in features_of(w)}


@dataclass
class Model:
    """Weights by feature."""

    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights.get(f, 0.0) for f in text_features(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def swaps(features: set[str], seed: int) -> set[str] | None:
    """The features with every identity term swapped for another of its group;
    None if there is none."""
    out, hit = set(features), False
    for group in IDENTITY.values():
        for k, term in enumerate(group):
            if term in features:
                other = group[(k + 1 + (seed + k) % (len(group) - 1)) % len(group)]
                out -= set(features_of(term))
                out |= set(features_of(other))
                hit = True
    return out if hit else None


def gain(absent: int, present: int, n0: int, n1: int) -> float:
    """Log-likelihood ratio of a feature's presence against the label, from its
    counts among negative and positive texts."""
    n, both, out = n0 + n1, absent + present, 0.0
    for k, m in ((absent, n0), (present, n1)):
        for x, p in ((k, both / n), (m - k, 1 - both / n)):
            if x and p:
                out += x * math.log(x / m / p)
    return out


def identity_features() -> list[str]:
    return sorted({f for g in IDENTITY.values() for t in g for f in features_of(t)})


def solve(chosen: list[str], rows: list, swapped: list, y: np.ndarray, weights: np.ndarray, fairness: float = FAIRNESS, ridge: float = RIDGE) -> Model:
    """Newton's method on the weighted log loss, a ridge, and the mean squared
    score change of counterfactual pairs.  ``rows`` and ``swapped`` hold places
    in ``chosen``; a text without identity terms has None as its swap."""
    y, total = np.asarray(y, np.float64), float(np.sum(weights))
    share = float((weights * y).sum() / total) if total else 0.0
    if not 0 < share < 1:
        return Model({}, 40.0 if share else -40.0)
    d = len(chosen)
    x = np.zeros((len(rows), d + 1), np.float32)
    x[:, d] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    pairs = [(r, s) for r, s in zip(rows, swapped) if s is not None]
    change = np.zeros((d + 1, d + 1))
    for r, s in pairs:
        row = np.zeros(d + 1)
        row[r] += 1
        row[s] -= 1
        at = np.flatnonzero(row)
        change[np.ix_(at, at)] += np.outer(row[at], row[at])
    penalty = np.full(d + 1, ridge)
    penalty[d] = 1e-9
    fixed = np.diag(penalty) + fairness / max(1, len(pairs)) * change
    w = np.zeros(d + 1)
    w[d] = math.log(share / (1 - share))
    weight = weights / total

    def cost(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x @ w.astype(np.float32)).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + w @ fixed @ w / 2), z

    now, z = cost(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = x.T @ (weight * (p - y)).astype(np.float32) + fixed @ w
        curve = (weight * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
        hessian = fixed.copy()
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            hessian += part.T @ (part * curve[a : a + 2048, None])
        step = np.linalg.solve(hessian, grad)
        # A whole step may overshoot where labels are nearly separable: halve it until the cost falls.
        size, slope = 1.0, float(grad @ step)
        then, z_then = cost(w - step)
        while then > now - 1e-4 * size * slope and size > 1e-6:
            size /= 2
            then, z_then = cost(w - size * step)
        if then >= now:
            break
        w, now, z = w - size * step, then, z_then
        if size * np.abs(step).max() < 1e-5:
            break
    return Model({f: round(float(v), 6) for f, v in zip(chosen, w) if abs(v) > 1e-6}, round(float(w[d]), 6))


def fit(texts: list[str | None], labels, weights=None, limit: int = FEATURES, **options) -> Model:
    """Fit on texts at hand."""
    sets, y = [text_features(t) for t in texts], np.asarray(labels, int)
    counts: dict[str, list[int]] = {}
    for s, positive in zip(sets, y.tolist()):
        for f in s:
            counts.setdefault(f, [0, 0])[positive] += 1
    n1 = int(y.sum())
    identity = identity_features()
    free_ = [f for f, c in counts.items() if sum(c) >= LEAST and f not in set(identity)] if 0 < n1 < len(y) else []
    chosen = sorted(free_, key=lambda f: (-gain(*counts[f], len(y) - n1, n1), f))[:limit] + identity
    place = {f: i for i, f in enumerate(chosen)}
    put = lambda s: None if s is None else [place[f] for f in s if f in place]
    return solve(chosen, [put(s) for s in sets], [put(swaps(s, i)) for i, s in enumerate(sets)], y, np.ones(len(y)) if weights is None else np.asarray(weights), **options)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sorted(text_features(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], ["train_id", "label", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, limit: int = FEATURES, **options) -> Model:
    """Fit on at most ``max_rows`` of the labelled rows.  Features are counted
    and chosen by the executors; the driver gets the places of chosen features
    in each training text only."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("train_id")).agg(F.max("toxic").cast("int").alias("label"))
    counted = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    order = F.xxhash64("train_id")
    parts = [marked.where(F.col("label") == label).orderBy(order, "train_id").limit(max_rows // 2) for label in (0, 1)]
    ids = parts[0].unionByName(parts[1])  # at most max_rows rows of two numbers
    texts = docs.select(col(id_col).cast("long").alias("train_id"), col(text_col).alias("text")).join(F.broadcast(ids), "train_id")
    # A repeated id takes part once, so that the sample's bound holds.
    texts = texts.groupBy("train_id", "label").agg(F.min("text").alias("text"))
    rows = Store(docs.sparkSession).keep(texts.mapInArrow(_features, "train_id long, label int, features array<string>"))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, 40.0 if n1 else -40.0)
    identity = identity_features()
    counts = rows.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    both = F.col("a") + F.col("b")
    term = lambda k, m, p: F.when((k > 0) & (p > 0), k * F.log(k / m / p)).otherwise(0.0)
    p = both / (n0 + n1)
    ratio = term(F.col("a"), n0, p) + term(n0 - F.col("a"), n0, 1 - p) + term(F.col("b"), n1, p) + term(n1 - F.col("b"), n1, 1 - p)
    best = counts.where((both >= LEAST) & ~F.col("f").isin(identity)).orderBy(F.round(ratio, 9).desc(), "f").limit(limit)
    chosen = [r.f for r in best.select("f").collect()] + identity
    place = {f: i for i, f in enumerate(chosen)}

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = lambda s: None if s is None else sorted(place[f] for f in s if f in place)
        for batch in batches:
            sets = [set(x) for x in batch.column(2).to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([put(s) for s in sets], ints), pa.array([put(swaps(s, k % 1000)) for s, k in zip(sets, batch.column(0).to_pylist())], ints)], ["train_id", "label", "own", "other"])

    got = sorted(rows.mapInArrow(place_rows, "train_id long, label int, own array<int>, other array<int>").collect())
    weight = {0: counted.get(0, 0) / n0, 1: counted.get(1, 0) / n1}
    return solve(chosen, [r.own for r in got], [r.other for r in got], np.array([r.label for r in got]), np.array([weight[r.label] for r in got], np.float64), **options)


class Scorer:
    """Scores batches of texts; knows the features of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {f: i for i, f in enumerate(model.weights)}
        self.weight = np.array([*model.weights.values(), 0.0])
        self.words = Words()
        self.has, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def score(self, texts: pa.Array) -> np.ndarray:
        index, sizes, new, keep = self.words.read(texts)
        if keep is not None:
            self.first, self.has = rows_of(self.first, self.has, keep)
        if new:
            got = [[self.place[f] for f in features_of(w.decode("utf-8", "replace")) if f in self.place] for w in new]
            self.has = np.concatenate((self.has, np.array([i for g in got for i in g], np.int64)))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(g) for g in got], dtype=np.int64)))
        counts = (self.first[1:] - self.first[:-1])[index]
        used = counts > 0
        doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes)[used], counts[used])
        feature = self.has[ranges(self.first[:-1][index[used]], counts[used])]
        once = np.unique(doc * len(self.weight) + feature)
        z = np.bincount(once // len(self.weight), weights=self.weight[once % len(self.weight)], minlength=len(sizes)) + self.model.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


_scorers: dict[int, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """This worker's scorer of a model; it outlives a task."""
    key = zlib.crc32(repr((sorted(model.weights.items()), model.intercept)).encode())
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score``; the text itself is dropped.  The model travels with the
    task: at most FEATURES weights and the identity terms."""
    base = docs.drop("score")
    names = [c for c in base.columns if c != text_col]
    (text,) = free(base, "text_of_row")
    schema = base.select(*(col(c) for c in names)).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(model)
        for batch in batches:
            for part in chunks(batch, text):
                get = lambda x, part=part: part.column(part.schema.get_field_index(x))
                yield pa.RecordBatch.from_arrays([*(get(x) for x in names), pa.array(scorer.score(get(text)))], [*names, "score"])

    return base.select(*(col(c) for c in names), col(text_col).alias(text)).mapInArrow(run, schema)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Fitted without the fold crc32(doc_id) mod 4 = 2."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    model = train(docs, labels.where(~fold(F.col("doc_id"))).select("doc_id", "toxic"))
    out = score(docs.withColumn("held_out", fold(F.col("doc_id"))), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
