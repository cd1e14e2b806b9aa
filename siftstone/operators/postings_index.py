"""A stored inverted index for BM25, with block maxima and many questions at once.

Documents are dealt into windows by a hash of their id, about ``DOCS`` to a window; a
block holds a term's postings in one window, so that no block is large and a common
term is as many small blocks, in files partitioned by term.  A block's head keeps its
highest term frequency and shortest length, which bound what a document in it can
score.  Added up over a question's terms, the heads bound every window.

Search reads first the windows with the best bounds, as many as results are asked for; the
k-th score found is a floor, and of all other windows only those are opened whose
bound reaches it.  A window is opened for all terms of the question, so scores are
whole, and the result is that of a full scan (``retrieval.bm25``).  An opened window's
blocks meet all questions that open it in one task, as a product of two matrices, and
only each question's k best documents of the window leave it.

The forward table is written in the order of the windows, so blocks are built from it
without a shuffle; where a task's rows end inside a window, its terms have two blocks.

Changes are segments (``segments``).  Counts of documents, lengths and document
frequencies are kept as sums of differences: a change takes the terms of the documents
that it replaces or deletes from the forward table, so that scores never count dead
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.lineage import kept
from siftstone.operators.retrieval import B, K1, top_k
from siftstone.operators.segments import Segments

#: Documents in a window on average, folders of terms, and terms of a search that
#: the scan is given as a list.
DOCS, PARTS, LISTED = 512, 64, 500
#: Texts split at once, questions that meet a window at once, and documents and terms
#: of one matrix.
TEXTS, ASKED, ROWS, TERMS = 512, 1024, 1024, 4096
ROOM = 2e-6
POSTINGS = "term string, window long, seq long, max_tf int, min_dl int, n int, postings array<struct<id:long,tf:int,dl:int>>, part int"
FORWARD = "id long, dl int, terms array<struct<term:string,tf:int>>, seq long"


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_POSTING = pa.struct([("id", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())])


def _lists(sizes: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms) of (id, text), texts being lower-case: the words of ``text.tokens``."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            text, n = part.column("text"), part.num_rows
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[first : first + ends[-1]]
            word = _WORD[data]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            heads = ends[:-1][ends[:-1] < len(data)]
            begins[heads] = word[heads]  # a text's first byte follows no other text's last
            begins = np.flatnonzero(begins)
            doc = np.searchsorted(ends, begins, "right")
            offsets = np.append(np.cumsum(word, dtype=np.int32)[begins] - 1, word.sum()).astype(np.int32)
            words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[word])).dictionary_encode()
            many = max(1, len(words.dictionary))
            pairs, tf = np.unique(doc * many + np.asarray(words.indices), return_counts=True)
            terms = {"term": words.dictionary.take(pa.array(pairs % many)), "tf": pa.array(tf, pa.int32())}
            yield pa.record_batch({"id": part.column("id"), "dl": pa.array(np.bincount(doc, minlength=n), pa.int32()), "terms": _lists(np.bincount(pairs // many, minlength=n), terms)})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the terms and windows of (id, dl, window, terms)."""
    for batch in batches:
        terms = batch.column("terms")
        sizes, flat = np.asarray(terms.value_lengths()), terms.flatten()
        if not len(flat):
            continue
        doc = np.repeat(np.arange(len(sizes)), sizes)
        ids, dl, window = (np.asarray(batch.column(c)) for c in ("id", "dl", "window"))
        words = flat.field("term").dictionary_encode()
        code, tf = np.asarray(words.indices), np.asarray(flat.field("tf"))
        by_id = np.empty(len(ids), np.int64)
        by_id[np.lexsort((ids, window))] = np.arange(len(ids))
        order = np.argsort(code * np.int64(len(ids)) + by_id[doc])
        code, tf, doc = code[order], tf[order], doc[order]
        new = np.append(True, (code[1:] != code[:-1]) | (window[doc[1:]] != window[doc[:-1]]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(code)))
        postings = _lists(sizes, {"id": pa.array(ids[doc]), "tf": pa.array(tf, pa.int32()), "dl": pa.array(dl[doc], pa.int32())})
        made = pa.record_batch({
            "term": words.dictionary.take(pa.array(code[begins])), "window": pa.array(window[doc[begins]]), "max_tf": pa.array(np.maximum.reduceat(tf, begins), pa.int32()),
            "min_dl": pa.array(np.minimum.reduceat(dl[doc], begins), pa.int32()), "n": pa.array(sizes, pa.int32()), "postings": postings})
        for at in range(0, made.num_rows, 65536):
            yield made.slice(at, 65536)


_HITS = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("matched_terms", pa.list_(pa.string()))])


def _flat(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in table.column(name).chunks])


def _alive_at(table: pa.Table, ids: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Which postings no later change names; a change's row has no term, and its ids
    are gone for what is older than its seq."""
    if not table.num_rows:
        return np.ones(len(ids), bool)
    gone, until = np.asarray(_flat(table, "ids")), np.repeat(np.asarray(table.column("seq")), np.asarray(pc.list_value_length(table.column("ids"))))
    order = np.lexsort((until, gone))
    gone, until = gone[order], until[order]
    at = np.searchsorted(gone, ids, "right") - 1  # the latest change of each
    return (at < 0) | (gone[at] != ids) | (seq >= until[at])


def _met(blocks: pa.Table, questions: pa.Table, k: int) -> pa.Table:
    """The k best documents of one window for each question, with what may tie with them."""
    out = {name: [] for name in _HITS.names}
    if blocks.num_rows and questions.num_rows:
        asked = _flat(questions, "terms")
        vocabulary = asked.unique()
        weights = np.zeros((len(vocabulary), questions.num_rows))
        weights[np.asarray(pc.index_in(asked, vocabulary)), np.repeat(np.arange(questions.num_rows), np.asarray(pc.list_value_length(questions.column("terms"))))] = np.asarray(_flat(questions, "idfs"))
        qid, avgdl = np.asarray(questions.column("qid")), questions.column("avgdl")[0].as_py()
        least = np.asarray(questions.column("least").fill_null(-np.inf)) - ROOM
        changes = blocks.filter(pc.is_null(blocks.column("term")))
        blocks = blocks.filter(pc.is_in(blocks.column("term"), vocabulary))
    if blocks.num_rows and questions.num_rows:
        sizes = np.asarray(pc.list_value_length(blocks.column("ids")))
        code, seq = (np.repeat(np.asarray(x), sizes) for x in (pc.index_in(blocks.column("term"), vocabulary), blocks.column("seq")))
        ids, tf, dl = (np.asarray(_flat(blocks, c)) for c in ("ids", "tfs", "dls"))
        alive = _alive_at(changes, ids, seq)
        ids, row = np.unique(ids[alive], return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, code, tf, dl = row[order], code[alive][order], tf[alive][order], dl[alive][order]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        starts = np.searchsorted(row, np.arange(len(ids) + 1))
        for at in range(0, len(ids), ROWS):
            n = min(ROWS, len(ids) - at)
            here = slice(starts[at], starts[at + n])
            score = np.zeros((n, len(qid)))
            for t in range(0, len(vocabulary), TERMS):
                some = (code[here] >= t) & (code[here] < t + TERMS)
                held = np.zeros((n, min(TERMS, len(vocabulary) - t)))
                held[row[here][some] - at, code[here][some] - t] = part[here][some]
                score += held @ weights[t : t + TERMS]
            r, q = np.nonzero((score > 0) & (score >= least))
            order = np.lexsort((r, -np.round(score[r, q], 6), q))
            r, q = r[order], q[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            for r, q in zip(r[best].tolist(), q[best].tolist()):
                held = code[starts[at + r] : starts[at + r + 1]]
                out["qid"].append(qid[q])
                out["id"].append(ids[at + r])
                out["score"].append(score[r, q])
                out["matched_terms"].append(sorted(vocabulary.take(pa.array(held[weights[held, q] > 0])).to_pylist()))
    return pa.table(out, schema=_HITS)


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.segments = spark, Segments(spark, path)

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", docs_each: int = DOCS) -> PostingsIndex:
        made = cls(docs.sparkSession, path)
        entry = made.segments.begin("base")
        entry["windows"] = max(1, docs.count() // docs_each)
        made._add(entry, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
        return made

    def _add(self, entry: dict, docs: DataFrame, replaced: DataFrame | None = None) -> None:
        """Write documents (id, text; those without an id are left out, of equal ids the
        greatest text stays), the counts that change, and commit."""
        window = self._window(entry["windows"])
        once = docs.where("id is not null").repartition(self._tasks(entry), window).groupBy(window.alias("window"), "id").agg(F.max("text").alias("text"))
        lower = once.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        forward = lower.mapInArrow(_counted, "id long, dl int, terms array<struct<term:string,tf:int>>").withColumn("seq", F.lit(entry["seq"]).cast("long"))
        self.segments.write(entry, "forward", forward)
        self._post(entry, replaced)

    @staticmethod
    def _window(windows: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(windows))

    def _tasks(self, entry: dict) -> int:
        """Tasks that write the forward table: enough for all cores, each with whole windows."""
        return max(1, entry["windows"] // 32, min(entry["windows"] // 8, 3 * self.spark.sparkContext.defaultParallelism))

    def _post(self, entry: dict, replaced: DataFrame | None) -> None:
        """Write the blocks of the forward table, the counts that change, and commit."""
        forward = self.segments.read("forward", FORWARD, [entry]).select("id", "dl", self._window(entry["windows"]).cast("long").alias("window"), "terms")
        blocks = forward.mapInArrow(_blocks, "term string, window long, max_tf int, min_dl int, n int, postings array<struct<id:long,tf:int,dl:int>>")
        blocks = blocks.select("term", "window", F.lit(entry["seq"]).cast("long").alias("seq"), "max_tf", "min_dl", "n", "postings", part_of(F.col("term")).alias("part"))
        self.segments.write(entry, "postings", blocks, "part")
        self._count(entry, replaced)
        self.segments.commit(entry)

    def _count(self, entry: dict, removed: DataFrame | None) -> None:
        """How a change moves document frequencies, the count and the length."""
        terms, rows = [], []
        if "postings" in entry["tables"]:
            terms.append(self.segments.read("postings", POSTINGS, [entry]).select("term", F.col("n").cast("long").alias("df")))
            rows.append(self.segments.read("forward", FORWARD, [entry]).select("dl", F.lit(1).alias("sign")))
        if removed is not None:
            terms.append(removed.select(F.explode("terms.term").alias("term"), F.lit(-1).cast("long").alias("df")))
            rows.append(removed.select("dl", F.lit(-1).alias("sign")))
        terms, rows = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in (terms, rows))
        df = terms.groupBy("term").agg(F.sum("df").alias("df"))
        self.segments.write(entry, "terms", df.withColumn("part", part_of(F.col("term"))).repartition("part"), "part")
        self.segments.write(entry, "totals", rows.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).cast("long").alias("length")))

    def _alive(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        """Rows (id, seq, ...) that no later change names."""
        if not any("gone" in e["tables"] for e in entries):
            return rows
        gone = self.segments.read("gone", "id long, until long", entries).groupBy("id").agg(F.max("until").alias("until"))
        return rows.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")

    def documents(self) -> DataFrame:
        """(id, dl, terms, seq) of what is alive."""
        entries = self.segments.live()
        return self._alive(self.segments.read("forward", FORWARD, entries).drop("segment"), entries)

    def _change(self, kind: str, ids: DataFrame, docs: DataFrame | None) -> None:
        before = self.documents()
        entry = self.segments.begin(kind)
        entry["windows"] = self.segments.live()[0]["windows"]
        ids = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        self.segments.write(entry, "gone", ids.withColumn("until", F.lit(entry["seq"] + (docs is None)).cast("long")))
        removed = before.join(self.segments.read("gone", "id long, until long", [entry]).select("id"), "id", "left_semi")
        if docs is None:
            self._count(entry, removed)
            self.segments.commit(entry)
        else:
            self._add(entry, docs, removed)

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self._change("upsert", rows, rows)

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents with these ids (column id)."""
        self._change("delete", ids, None)

    def compact(self, docs_each: int = DOCS) -> None:
        """Write what is alive as one base, from the forward tables."""
        alive = self.documents()
        entry = self.segments.begin("base")
        entry["windows"] = max(1, alive.count() // docs_each)
        window = self._window(entry["windows"])
        self.segments.write(entry, "forward", alive.withColumn("seq", F.lit(entry["seq"]).cast("long")).repartition(self._tasks(entry), window).sortWithinPartitions(window, "id"))
        self._post(entry, None)

    def _bounded(self, questions: DataFrame) -> tuple[DataFrame, DataFrame, list[dict]]:
        """(qid, term, idf, avgdl) of the questions, and (qid, window, bound)."""
        entries = self.segments.live()
        asked = questions.select(F.col("qid").cast("long").alias("qid"), F.explode("terms").alias("term")).distinct()
        totals = self.segments.read("totals", "n long, length long", entries).agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
        df = self._of(self.segments.read("terms", "term string, df long, part int", entries), asked).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = kept(asked.join(df, "term").join(F.broadcast(totals)).select("qid", "term", idf.alias("idf"), "avgdl"))  # totals: one row
        heads = self._of(self.segments.read("postings", POSTINGS, entries), weighed).groupBy("term", "window").agg(F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl"))
        bounds = weighed.join(heads, "term").groupBy("qid", "window").agg(F.sum(self._part()).alias("bound"), F.count(F.lit(1)).alias("blocks"))
        return weighed, kept(bounds), entries

    def _of(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows of the folders that the asked terms are in, and of those terms alone
        where they are few enough to go with the scan."""
        terms = [r.term for r in asked.select("term").distinct().limit(LISTED + 1).collect()]
        if len(terms) <= LISTED:
            rows = rows.where(F.col("term").isin(terms))
        parts = [r.part for r in asked.select(part_of(F.col("term")).alias("part")).distinct().collect()]  # at most PARTS
        rows = rows.where(F.col("part").isin(parts))
        return rows if len(terms) <= LISTED else rows.join(asked.select("term").distinct(), "term", "left_semi")

    @staticmethod
    def _part() -> Column:
        return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    def _scored(self, weighed: DataFrame, opened: DataFrame, entries: list[dict], k: int) -> DataFrame:
        """(qid, id, score, matched_terms) of the k best documents in each opened (qid,
        window, least), but for those that score below least."""
        cells = 1 + weighed.select("qid").distinct().count() // ASKED  # a cell: a window and some of the questions
        pairs = opened.join(weighed, "qid").select("term", "window").distinct()
        blocks = self._of(self.segments.read("postings", POSTINGS, entries), weighed).join(pairs, ["term", "window"], "left_semi")
        blocks = blocks.select("window", "term", "seq", F.col("postings.id").alias("ids"), F.col("postings.tf").alias("tfs"), F.col("postings.dl").alias("dls"))
        if any("gone" in e["tables"] for e in entries):
            gone = self.segments.read("gone", "id long, until long", entries).groupBy(self._window(entries[0]["windows"]).alias("window"), "until").agg(F.collect_list("id").alias("ids"))
            none = F.array().cast("array<int>")
            blocks = blocks.unionByName(gone.select("window", F.lit(None).cast("string").alias("term"), F.col("until").alias("seq"), "ids", none.alias("tfs"), none.alias("dls")))
        blocks = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        asked = weighed.groupBy("qid").agg(F.max("avgdl").alias("avgdl"), F.collect_list(F.struct("term", "idf")).alias("of"))
        asked = asked.select("qid", "avgdl", F.col("of.term").alias("terms"), F.col("of.idf").alias("idfs"), F.pmod(F.xxhash64("qid"), F.lit(cells)).cast("int").alias("cell"))
        asked = opened.join(asked, "qid")
        met = blocks.groupBy("window", "cell").cogroup(asked.groupBy("window", "cell")).applyInArrow(lambda b, q: _met(b, q, k), "qid long, id long, score double, matched_terms array<string>")
        return met.withColumn("score", F.round("score", 6))

    def plan(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(weighed terms, bounds, first results, windows that are opened after them)."""
        weighed, bounds, entries = self._bounded(questions)
        first = kept(top_k(bounds, k, "bound", "window", "qid").select("qid", "window"))
        found = kept(top_k(self._scored(weighed, first.withColumn("least", F.lit(None).cast("double")), entries, k), k, "score", "id", "qid").drop("rank"))
        floor = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")
        rest = bounds.join(first, ["qid", "window"], "left_anti").join(floor, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROOM))
        return weighed, bounds, found, rest.select("qid", "window", "least")

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, matched_terms, rank) for questions (qid, terms: lower-case tokens)."""
        weighed, _, found, rest = self.plan(questions, k)
        both = found.unionByName(self._scored(weighed, kept(rest), self.segments.live(), k))
        return top_k(both, k, "score", "id", "qid")
