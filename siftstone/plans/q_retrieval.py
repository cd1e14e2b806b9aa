"""Dense, sparse and fused search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.lineage import folder
from siftstone.functions.text import tokens
from siftstone.operators import retrieval as r
from siftstone.operators.postings_index import PostingsIndex
from siftstone.operators.vector_index import VectorIndex
from siftstone.plans.registry import query, table

TERMS = ["from", "that", "with"]

_Q = "SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0"
DENSE = f"""
dense_all AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS score FROM embeddings, ({_Q})),
dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense_all ORDER BY score DESC, id LIMIT 20)"""


def sparse_sql(kind: str, k: int = 20) -> str:
    score = {"bm25": "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))",
             "tfidf": "tf::DOUBLE / dl * (ln((1 + n)::DOUBLE / (1 + df)) + 1)"}[kind]
    return f"""
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok) WHERE term IN ('from', 'that', 'with') GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sparse_all AS (SELECT id, round(sum({score}), 6) AS score, list_sort(list(term)) AS matched_terms FROM tf JOIN df USING (term), tot GROUP BY id),
sparse AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sparse_all ORDER BY score DESC, id LIMIT {k})"""


GRAPH = """
graph AS (
  SELECT vec_id AS id, round(pow(0.5, 1 + vec_id % 3), 6) AS score FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0)
  ORDER BY score DESC, id LIMIT 10)"""
HITS = f"""{DENSE}, {sparse_sql('bm25')}, {GRAPH},
hits AS (
  SELECT id, 'vector' AS source, score, rank FROM dense UNION ALL
  SELECT id, 'sparse', score, rank FROM sparse UNION ALL
  SELECT id, 'graph', score, row_number() OVER (ORDER BY score DESC, id) FROM graph)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _question(spark, sf_dir):
    return _vectors(spark, sf_dir).where("id = 0").select(F.col("id").alias("qid"), "embedding")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _lists(spark, sf_dir):
    dense = r.knn(_question(spark, sf_dir), _vectors(spark, sf_dir), 20).select("id", "score")
    sparse = r.bm25(_texts(spark, sf_dir), TERMS, 20).select("id", "score")
    vectors = table(spark, sf_dir, "embeddings")
    same = vectors.join(F.broadcast(vectors.where("vec_id = 0").select("label")), "label")  # one row
    graph = r.top_k(same.select(F.col("vec_id").alias("id"), F.round(F.pow(F.lit(0.5), 1 + F.col("vec_id") % 3), 6).alias("score")), 10).select("id", "score")
    return dense, sparse, graph


def _hits(spark, sf_dir):
    lists = zip(r.SOURCES, _lists(spark, sf_dir))
    out = [r.ranked(hits, source) for source, hits in lists]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("knn_cosine", f"WITH {DENSE} SELECT 0 AS qid, id, score, rank FROM dense")
def knn_cosine(spark, sf_dir):
    return r.knn(_question(spark, sf_dir), _vectors(spark, sf_dir), 20)


@query("knn_batch", """
SELECT qid, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 5""")
def knn_batch(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return r.knn(vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), vectors, 5, keep_self=False)


@query("knn_filtered", f"""
SELECT 0 AS qid, id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS score FROM embeddings, ({_Q}) WHERE label IN (1, 3, 5))
ORDER BY score DESC, id LIMIT 10""")
def knn_filtered(spark, sf_dir):
    """The metadata filter reaches the scan, before the top-k."""
    return r.knn(_question(spark, sf_dir), _vectors(spark, sf_dir).where(F.col("label").isin(1, 3, 5)), 10)


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return r.lsh_knn(vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), vectors, 5, keep_self=False)


@query("bm25_topk", f"WITH {sparse_sql('bm25')} SELECT id, score, matched_terms, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return r.bm25(_texts(spark, sf_dir), TERMS, 20)


@query("tfidf_topk", f"WITH {sparse_sql('tfidf')} SELECT id, score, matched_terms, rank FROM sparse")
def tfidf_topk(spark, sf_dir):
    return r.tfidf(_texts(spark, sf_dir), TERMS, 20)


@query("fuse_rrf", f"""
WITH {HITS}, f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, list_sort(list(source)) AS sources FROM hits GROUP BY id)
SELECT id, score, sources, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY score DESC, id LIMIT 10""")
def fuse_rrf(spark, sf_dir):
    return r.rrf(_hits(spark, sf_dir), 10)


@query("fuse_weighted", f"""
WITH {HITS},
m AS (SELECT source, min(score) AS lo, max(score) AS hi FROM hits GROUP BY source),
f AS (
  SELECT id, round(sum(CASE WHEN hi - lo < 1e-10 THEN 1.0::DOUBLE ELSE (score - lo) / (hi - lo) END * CASE source WHEN 'vector' THEN 0.5::DOUBLE WHEN 'sparse' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END), 6) AS score,
    list_sort(list(source)) AS sources FROM hits JOIN m USING (source) GROUP BY id)
SELECT id, score, sources, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY score DESC, id LIMIT 10""")
def fuse_weighted(spark, sf_dir):
    return r.weighted(_hits(spark, sf_dir), {"vector": 0.5, "sparse": 0.3, "graph": 0.2}, 10)


@query("fuse_features", f"""
WITH {HITS},
w AS (
  SELECT id, max(score) FILTER (source = 'vector') AS sv, max(score) FILTER (source = 'sparse') AS ss, max(score) FILTER (source = 'graph') AS sg,
    min(rank) FILTER (source = 'vector') AS rv, min(rank) FILTER (source = 'sparse') AS rs, min(rank) FILTER (source = 'graph') AS rg FROM hits GROUP BY id)
SELECT id, coalesce(round(sv, 6), 0) AS f0, coalesce(round(ss, 6), 0) AS f1, coalesce(round(sg, 6), 0) AS f2,
  coalesce(round(1.0::DOUBLE / rv, 6), 0) AS f3, coalesce(round(1.0::DOUBLE / rs, 6), 0) AS f4, coalesce(round(1.0::DOUBLE / rg, 6), 0) AS f5,
  (sv IS NOT NULL)::DOUBLE AS f6, (ss IS NOT NULL)::DOUBLE AS f7, (sg IS NOT NULL)::DOUBLE AS f8,
  ((sv IS NOT NULL)::INT + (ss IS NOT NULL)::INT + (sg IS NOT NULL)::INT)::DOUBLE AS f9,
  coalesce(round(sv - ss, 6), 0) AS f10, coalesce(round(sv - sg, 6), 0) AS f11, coalesce(round(ss - sg, 6), 0) AS f12,
  round(greatest(sv, ss, sg), 6) AS f13,
  round((coalesce(sv, 0) + coalesce(ss, 0) + coalesce(sg, 0)) / ((sv IS NOT NULL)::INT + (ss IS NOT NULL)::INT + (sg IS NOT NULL)::INT), 6) AS f14
FROM w""")
def fuse_features(spark, sf_dir):
    return r.fusion_features(_hits(spark, sf_dir))


@query("compare_methods", f"""
WITH {DENSE}, {sparse_sql('bm25')}
SELECT coalesce(d.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'only_a' WHEN d.id IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM dense d FULL OUTER JOIN sparse s ON d.id = s.id""")
def compare_methods(spark, sf_dir):
    dense, sparse, _ = _lists(spark, sf_dir)
    return r.compare(dense, sparse)


@query("hybrid_search", f"""
WITH {HITS.replace("(SELECT label FROM embeddings WHERE vec_id = 0)", "(SELECT label FROM embeddings WHERE vec_id = 0) AND vec_id <> 0")}, f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM hits GROUP BY id),
t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f ORDER BY score DESC, id LIMIT 10)
SELECT t.id, t.score, t.rank, d.source, d.lang FROM t JOIN documents d ON d.doc_id = t.id""")
def hybrid_search(spark, sf_dir):
    """Dense, sparse and graph lists, fused, then joined with their records."""
    from siftstone.operators import compose

    vectors = table(spark, sf_dir, "embeddings")
    seed = vectors.where("vec_id = 0").select(F.col("vec_id").alias("source"), "label")
    edges = vectors.where("vec_id <> 0").join(F.broadcast(seed), "label").select("source", F.col("vec_id").alias("target"), F.pow(F.lit(0.5), F.col("vec_id") % 3).alias("weight"))  # one seed
    fused = compose.hybrid(_question(spark, sf_dir), _vectors(spark, sf_dir), _texts(spark, sf_dir), TERMS, edges, seed.select(F.col("source").alias("id"))).select("id", "score", "rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return docs.join(F.broadcast(fused), "id").select("id", "score", "rank", "source", "lang")


@query("reflective_retrieve", f"""
WITH {DENSE}, g AS (SELECT id, score FROM dense WHERE score >= 0.3)
SELECT count(*) AS n_kept, coalesce(round(avg(score), 6), 0) AS coverage,
  CASE WHEN count(*) = 0 THEN 'irrelevant' WHEN avg(score) >= 0.8 THEN 'excellent' WHEN avg(score) >= 0.6 THEN 'good' WHEN avg(score) >= 0.4 THEN 'partial' ELSE 'poor' END AS quality,
  count(*) = 0 OR avg(score) < 0.4 AS needs_web_search FROM g""")
def reflective_retrieve(spark, sf_dir):
    """Relevance filter, coverage, and a grade without a language model."""
    kept = r.knn(_question(spark, sf_dir), _vectors(spark, sf_dir), 20).where("score >= 0.3")
    mean, n = F.avg("score"), F.count(F.lit(1))
    grade = F.when(n == 0, "irrelevant").when(mean >= 0.8, "excellent").when(mean >= 0.6, "good").when(mean >= 0.4, "partial").otherwise("poor")
    return kept.agg(n.alias("n_kept"), F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("coverage"), grade.alias("quality"), ((n == 0) | (mean < 0.4)).alias("needs_web_search"))


@query("per_modality_topk", """
SELECT source, id, score, rank FROM (
  SELECT source, doc_id AS id, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5""")
def per_modality_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return r.top_k(docs, 5, "score", "id", "source")


#: What the index went through before the search, told by label: 8 and 9 come late,
#: those of 5 are replaced by their opposites, those of 3 are deleted.
_NOW = "SELECT vec_id AS id, CASE WHEN label = 5 THEN list_transform(embedding, lambda x: -x) ELSE embedding END::DOUBLE[] AS e FROM embeddings WHERE label IS DISTINCT FROM 3"


@query("vector_index_search", f"""
WITH now AS ({_NOW}), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, id, round(list_cosine_similarity(e, qe), 6) AS score FROM q, now)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_index_search(spark, sf_dir):
    """Exact search in a stored index after late rows, replacements and deletes."""
    rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows.where("label is null or label < 8").select("id", "embedding"), folder(spark))
    index.upsert(rows.where("label >= 8").select("id", "embedding").unionByName(rows.where("label = 5").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))))
    index.delete(rows.where("label = 3").select("id"))
    return index.search(rows.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), 10, exact=True)


@query("postings_index_search", """
WITH now AS (SELECT doc_id AS id, CASE WHEN lang = 'de' THEN concat(text, ' ', lang, ' ', source) ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3'),
tok AS MATERIALIZED (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM now),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark),
s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS terms FROM q JOIN tf USING (term) JOIN df USING (term), tot GROUP BY qid, id)
SELECT qid, id, score, terms, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def postings_index_search(spark, sf_dir):
    """All benchmark items as questions to a stored index: the documents of src7 come
    late, German ones are replaced, those of src3 are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    index = PostingsIndex.build(docs.where("source is null or source <> 'src7'").select("doc_id", "text"), folder(spark))
    german = docs.where("lang = 'de' and text is not null").select("doc_id", F.concat_ws(" ", "text", "lang", "source").alias("text"))
    index.upsert(docs.where("source = 'src7' and (lang is null or lang <> 'de')").select("doc_id", "text").unionByName(german))
    index.delete(docs.where("source = 'src3'").select(F.col("doc_id").alias("id")))
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), tokens(F.col("text")).alias("terms"))
    return index.search(questions, 5).select("qid", "id", "score", F.size("matched_terms").cast("long").alias("terms"), "rank")
