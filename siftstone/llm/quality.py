"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules are fixed.  Further rules are ratios of a document; each rejects
above a cutoff, and the cutoffs are chosen on labelled holdouts, for every
stratum (language) by itself.  The fixed, documented cutoffs form one path of
joint levels, from mild to strict: at level i a document is rejected if any of its
ratios is above that rule's i-th cutoff.  The levels are tested in this order: the
null hypothesis is that more than the allowed share of good documents (that
pass the base rules) is rejected, and it is dropped where the exact binomial tail
P(X <= rejected | n, allowed) is at most the stratum's level.  Testing stops at
the first failure (a fixed sequence needs no further correction); over the strata
that are tested the level is divided (Bonferroni).  So, with probability 1 - DELTA over
the holdouts, no stratum loses more than ALLOWED of its good documents.

What is proven of a level holds for every milder cutoff of each rule, so within
the proven levels each rule's cutoff is free: the mildest that rejects most bad
labelled documents less good ones, and none where that is not above 0.

Without a false rejection m strata are proven by ln(DELTA / m) / ln(1 - ALLOWED) good
labels each: 149 for one, 217 for four.  Tested are the m strata with the most good
labels, for the largest m of which each has so many; how many labels there are is
known before any rejection is looked at, so the choice costs nothing.  The other strata
could prove nothing and reject nothing.

Rows: a null or wordless text has no words and fails the base rules; a null
language is a stratum of its own; labels with null id or quality are unused, a
document labelled twice is good if every row says so; repeated rows are each
judged.  Columns of the input that have the name of a measure or ``kept`` are
replaced.  Empty tables give empty results.  Texts are measured
whole, however long; one row holds a text's words while it is measured.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Store, col, free

#: ASCII blanks, and symbols that the contract counts.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Largest share of good documents that all rules together may reject in a
#: stratum, and the chance that any stratum's share exceeds that bound.
ALLOWED = 0.02
DELTA = 0.05
#: Cutoffs of each ratio, from mild to strict.
CUTOFFS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04),
    "repeat_ratio": (0.5, 0.45, 0.4, 0.35, 0.3, 0.27, 0.24, 0.21, 0.18, 0.16, 0.14, 0.12),
    "line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "mark_ratio": (0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.22, 0.19, 0.16, 0.13, 0.1),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *CUTOFFS)
#: As many strata may be broadcast; more are joined by a shuffle.
FEW = 10_000


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and not copied into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""

    def places(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, j: F.coalesce(F.get(sorted_, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, j + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def cover(at: Column) -> Column:
        gaps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, lambda s: let(places(s), cover)))

    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(grams(words), count))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and the ratios of every document."""
    base = docs.drop(*MEASURES)
    (packed,) = free(base, "measured")
    text = F.coalesce(col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    distinct_lines = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    counted = let(words_of(col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    length = lambda x: F.char_length(x).cast("long")
    out = base.withColumns({
        packed: F.struct(
            counted.alias("w"), distinct_lines.alias("l"),
            length(F.translate(text, BLANKS, "")).alias("chars"),
            (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("symbols"),
            F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).alias("marks"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).alias("upper")),
    })
    x = lambda name: F.col(f"{packed}.{name}")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.select(
        *(col(c) for c in base.columns), x("w.n").alias("n_words"), x("chars").alias("word_chars"), x("symbols").alias("n_symbols"),
        (x("l.all") - x("l.distinct")).cast("long").alias("n_dup_lines"), x("w.r").alias("n_repeat_words"),
        ((x("w.n") < 50) | (100 * x("w.r") > 50 * x("w.n"))).alias("base_failed"),
        share(x("symbols"), x("chars")).alias("symbol_ratio"), share(x("w.r"), x("w.n")).alias("repeat_ratio"),
        share(x("l.all") - x("l.distinct"), x("l.all")).alias("line_ratio"),
        share(x("marks"), x("chars")).alias("mark_ratio"), share(x("upper"), x("chars")).alias("upper_ratio"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 10, stepped back."""
    z = x + 10
    steps = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - steps


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p; 1 where k is not below the
    mean.  Terms are summed from the k-th down: j places below it a term is less
    than exp(-j * j / (2 n p)) of the k-th, so those beyond 9 * sqrt(n p) + 40
    places cannot change a double."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    down = lambda j: j / (n - j + 1) * ((1 - p) / p)
    steps = F.sequence(F.lit(0), F.least(k, 9 * F.sqrt(n * p) + 40).cast("int"))
    start = F.struct(top.alias("term"), F.lit(0.0).alias("sum"))
    summed = F.aggregate(steps, start, lambda a, i: F.struct((a["term"] * down(k - i)).alias("term"), (a["sum"] + a["term"]).alias("sum")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(summed["sum"], F.lit(1.0)))


LEVELS = len(CUTOFFS["symbol_ratio"])


def choose_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", allowed: float = ALLOWED, delta: float = DELTA) -> DataFrame:
    """Rows (stratum, n_good, level, and a cutoff or null for each rule);
    ``level`` is the strictest proven one, from 0, or -1."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("held_id")).agg(F.min("quality").alias("held_quality"))
    held = measured.where(~F.col("base_failed")).select(col(id_col).cast("long").alias("held_id"), col(stratum_col).alias("stratum"), *CUTOFFS).join(marks, "held_id")
    # The first level that rejects a document, by each rule and by all together.
    first = {rule: sum(((F.col(rule) <= cut).cast("int") for cut in cuts), F.lit(0)) for rule, cuts in CUTOFFS.items()}
    first["all"] = F.least(*first.values())
    cells = F.array(*(F.struct(F.lit(rule).alias("rule"), at.alias("first")) for rule, at in first.items()))
    good = F.col("held_quality") == 1
    counted = held.select("stratum", good.alias("good"), F.inline(cells)).groupBy("stratum", "rule", "first").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # A row for each stratum, rule and level: how many of each are rejected.
    listed = counted.groupBy("stratum", "rule").agg(F.collect_list(F.struct("first", "good", "bad")).alias("cells"), F.sum("good").alias("n_good"))
    upto = lambda i, what: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["first"] <= i, c[what]).otherwise(0))
    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.struct(i.alias("i"), upto(i, "good").alias("k"), upto(i, "bad").alias("hit")))
    listed = listed.where("n_good > 0").select("stratum", "rule", "n_good", levels.alias("levels"))
    every = Window.partitionBy(F.lit(0))  # a row a stratum
    joint = listed.where("rule = 'all'").withColumn("place", F.row_number().over(every.orderBy(F.col("n_good").desc(), "stratum")))
    able = F.col("n_good") >= F.log(F.lit(delta) / F.col("place")) / math.log1p(-allowed)
    joint = joint.withColumn("strata", F.coalesce(F.max(F.when(able, F.col("place"))).over(every), F.lit(0)))
    tested = joint.select("stratum", "n_good", "place", "strata", F.inline("levels"))
    fails = (F.col("place") > F.col("strata")) | (binomial_tail(F.col("n_good"), F.col("k"), allowed) > F.lit(delta) / F.col("strata"))
    proven = tested.groupBy("stratum").agg((F.coalesce(F.min(F.when(fails, F.col("i"))), F.lit(LEVELS)) - 1).alias("level"))
    within = listed.where("rule <> 'all'").join(proven.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")))
    gains = F.transform(F.filter("levels", lambda x: x["i"] <= F.col("level")), lambda x: F.struct((x["hit"] - x["k"]).alias("gain"), (-x["i"]).alias("milder")))
    best = F.array_max(gains)
    chosen = within.select("stratum", "n_good", "level", "rule", F.when(best["gain"] > 0, -best["milder"]).alias("at"))
    cut = lambda rule, cuts: F.get(F.array(*map(F.lit, cuts)), F.max(F.when(F.col("rule") == rule, F.col("at")))).alias(f"{rule}_cutoff")
    return chosen.groupBy("stratum", "n_good", "level").agg(*(cut(rule, cuts) for rule, cuts in CUTOFFS.items()))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Adds ``kept``: passes the base rules and every chosen cutoff."""
    base = measured.drop("kept")
    stratum, *cuts = free(base, "stratum", *(f"{r}_cutoff" for r in CUTOFFS))
    small = cutoffs.select(F.col("stratum").alias(stratum), *(F.col(f"{r}_cutoff").alias(c) for r, c in zip(CUTOFFS, cuts)))
    if cutoffs.count() <= FEW:
        small = F.broadcast(small)
    out = base.join(small, col(stratum_col).eqNullSafe(F.col(stratum)), "left")
    passed = ~F.col("base_failed")
    for rule, cut in zip(CUTOFFS, cuts):
        passed = passed & F.coalesce(F.col(rule) <= F.col(cut), F.lit(True))
    return out.select(*(col(c) for c in base.columns), passed.alias("kept"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", with_text: bool = True) -> DataFrame:
    """Documents with their measures and ``kept``.  The measures are written
    once to the shared folder, as cutoffs and verdicts both read them."""
    store = Store(docs.sparkSession)
    measured = measure(docs, text_col)
    measured = store.keep(measured if with_text else measured.drop(text_col))
    cutoffs = store.keep(choose_cutoffs(measured, labels, id_col, stratum_col))
    return judge(measured, cutoffs, stratum_col)


def op10_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = apply_rules(docs, table(spark, sf_dir, "labels"), with_text=False)
    return out.select("doc_id", *MEASURES[:6], "kept")


def _sql() -> str:
    rules = ", ".join(f"({rule!r}, {i}, {cut!r}::DOUBLE)" for rule, cuts in CUTOFFS.items() for i, cut in enumerate(cuts))
    long = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, {rule} AS x FROM held" for rule in CUTOFFS)
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS MATERIALIZED (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS r
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]')) AS marks, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper
  FROM docs d LEFT JOIN repeats USING (doc_id)),
measured AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS line_ratio, coalesce(marks / nullif(word_chars, 0), 0) AS mark_ratio,
    coalesce(upper / nullif(word_chars, 0), 0) AS upper_ratio
  FROM counts),
marks AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS MATERIALIZED (SELECT m.*, q FROM measured m JOIN marks USING (doc_id) WHERE NOT base_failed),
cuts(rule, i, cut) AS (VALUES {rules}),
firsts AS (SELECT doc_id, rule, count(*) FILTER (x <= cut) AS first FROM ({long}) JOIN cuts USING (rule) GROUP BY doc_id, rule),
cells AS (
  SELECT rule, first, lang, q FROM firsts JOIN held USING (doc_id)
  UNION ALL SELECT 'all', min(first), any_value(lang), any_value(q) FROM firsts JOIN held USING (doc_id) GROUP BY doc_id),
levels AS (
  SELECT coalesce('s' || lang, '') AS stratum, rule, i, count(*) FILTER (q = 1) AS n_good, count(*) FILTER (q = 1 AND first <= i) AS k, count(*) FILTER (q <> 1 AND first <= i) AS hit
  FROM cells, (SELECT unnest(range({LEVELS})) AS i) GROUP BY ALL HAVING count(*) FILTER (q = 1) > 0),
tails AS (
  SELECT stratum, i, CASE WHEN k >= n_good * {ALLOWED} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({ALLOWED}) + (n_good - j) * ln(1 - {ALLOWED}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) END AS p
  FROM levels WHERE rule = 'all'),
placed AS (SELECT stratum, n_good, row_number() OVER (ORDER BY n_good DESC, stratum) AS place FROM (SELECT DISTINCT stratum, n_good FROM levels WHERE rule = 'all')),
able AS (SELECT coalesce(max(place) FILTER (n_good >= ln({DELTA} / place) / ln(1 - {ALLOWED})), 0) AS m FROM placed),
proven AS (
  SELECT stratum, coalesce(min(i) FILTER (place > m OR p > {DELTA} / m), {LEVELS}) - 1 AS level FROM tails JOIN placed USING (stratum), able GROUP BY stratum),
best AS (
  SELECT stratum, rule, i FROM levels JOIN proven USING (stratum) WHERE rule <> 'all' AND i <= level AND hit > k
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY hit - k DESC, i) = 1),
chosen AS (SELECT stratum, {", ".join(f"max(cut) FILTER (rule = {rule!r}) AS {rule}_cutoff" for rule in CUTOFFS)} FROM best JOIN cuts USING (rule, i) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce({rule} <= {rule}_cutoff, true)" for rule in CUTOFFS)} AS kept
FROM measured LEFT JOIN chosen ON stratum = coalesce('s' || lang, '')
"""


#: The same rows for documents with distinct ids.
OP10_SQL = _sql()
