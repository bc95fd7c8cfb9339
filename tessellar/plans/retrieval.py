"""Retrieval queries: BM25, exact nearest neighbours, fusion, admission, hits and summaries.

Chunks are all documents, a session is a language; a document has the vector of its number,
if there is one. Questions are all items of the benchmark, each asked in every session
(``qid`` is ``item/session``) with the vector numbered 50 times the item, if there is one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import DEFAULTS
from tessellar.functions.text import numeric_heavy
from tessellar.operators import lexical
from tessellar.operators import search as S
from tessellar.plans import sqltext
from tessellar.work import shared_root, spread


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chunk."""
    return spread(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").select(
        F.col("lang").alias("session_id"), F.col("doc_id").alias("chunk_id"), "source", "text"
    )


def _index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The written index of all documents: made by the first query of an application that asks, read by the others."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId} {sf}".encode()).hexdigest()
    return lexical.IndexStore(spark, f"{shared_root(spark)}/tessellar/lexical/{name}").index(_documents(spark, sf))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Every item in every session."""
    sessions = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("session_id")).distinct()
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return items.join(F.broadcast(sessions)).select(
        F.concat_ws("/", "item_id", "session_id").alias("qid"), "item_id", "session_id", "text"
    )


def _vectors(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias(name), "embedding")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, with its vector if it has one."""
    docs = _documents(spark, sf).withColumn("numeric_heavy", numeric_heavy(F.coalesce("text", F.lit(""))))
    return docs.join(_vectors(spark, sf, "chunk_id"), "chunk_id", "left").select(
        "session_id", "chunk_id", "source", "text", "numeric_heavy", "embedding"
    )


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every item in every session, with its vector if it has one."""
    return _items(spark, sf).withColumn("v", F.col("item_id") * 50).join(_vectors(spark, sf, "v"), "v", "left").drop("v", "item_id")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return S.candidates(_questions(spark, sf), _chunks(spark, sf), DEFAULTS.top_k, index=_index(spark, sf))


def searched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Hits and summary of all questions."""
    return S.search(_questions(spark, sf), _chunks(spark, sf), index=_index(spark, sf))


def term_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    terms = _index(spark, sf).terms
    return terms.select("session_id", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks, items = _documents(spark, sf), _items(spark, sf)
    scored = lexical.score(_index(spark, sf), items)
    best = lexical.top(scored, items, chunks, DEFAULTS.top_k)
    return best.select("qid", "chunk_id", "rank", F.round("bm25", 5).alias("bm25"), F.round("coverage", 5).alias("coverage"))


def query_coverage(spark: SparkSession, sf: str) -> DataFrame:
    scored = lexical.score(_index(spark, sf), _items(spark, sf))
    return scored.where(F.round("coverage", 6) >= 0.5).select("qid", "chunk_id", F.round("coverage", 6).alias("coverage"))


def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.lit(1).alias("session_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    probes = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "session_id", "embedding")
    return S.dense_top(probes, vectors, DEFAULTS.pool_factor * DEFAULTS.top_k).select("qid", "chunk_id", "rank", "score")


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf)
    return found.select("qid", "chunk_id", "d_rank", "l_rank", "fused", F.round("rrf", 8).alias("rrf"), "raw_score")


def admission_routes(spark: SparkSession, sf: str) -> DataFrame:
    judged = S.admitted(_found(spark, sf), DEFAULTS.min_score)
    return judged.groupBy("qid").agg(
        *[F.count(F.when(F.col("route") == r, 1)).alias(f"n_{r}") for r in ("dense", "both", "lexical")],
        F.count(F.when(F.col("route").isNull(), 1)).alias("n_dropped"),
        F.sum(F.col("passed").cast("int")).alias("n_passed"),
    )


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = searched(spark, sf)
    return hits.select("qid", "place", "chunk_id", "source", "route", "score", "raw_score", F.round("support", 5).alias("support"))


def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf)[1]


def source_cap_backfill(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.lit(1).alias("session_id"), F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("source"), "embedding"
    )
    probes = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "session_id", "embedding")
    near = S.dense_top(probes, vectors, DEFAULTS.pool_factor * DEFAULTS.top_k).join(vectors.select("chunk_id", "source"), "chunk_id")
    held = S.capped(near, "source", "rank", DEFAULTS.max_per_source, DEFAULTS.top_k)
    return held.select("qid", "chunk_id", "source", "rank", "place")


def rerank_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The tiering with a scorer that can be checked: shared distinct words over the passage's length."""

    def scorer(question, text):
        a, b = F.split(F.lower(question), " "), F.split(F.lower(text), " ")
        return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)), 8)

    named = _found(spark, sf).join(_items(spark, sf).select("qid", F.col("text").alias("query_text")), "qid").join(_documents(spark, sf).select("chunk_id", "text"), "chunk_id")
    return S.reranked(named, scorer).select("qid", "chunk_id", "fused", "order")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, term_df_idf, query_coverage, knn_cosine_topk, rrf_fusion, admission_routes, hybrid_search, search_summary,
        source_cap_backfill, rerank_tiers,
    )
}

_LEXICAL = f"""
tok AS (SELECT session_id, chunk_id, {sqltext.tokens("coalesce(text, '')")} AS t FROM chunks),
post AS (SELECT session_id, chunk_id, term, count(*) AS tf FROM (SELECT session_id, chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
sums AS (SELECT session_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY ALL),
terms AS (
  SELECT p.session_id, p.term, p.df, ln(1 + (s.n - p.df + 0.5) / (p.df + 0.5)) AS idf
  FROM (SELECT session_id, term, count(*) AS df FROM post GROUP BY ALL) p JOIN sums s USING (session_id)
)"""

_SCORED = f"""
qtok AS (
  SELECT qid, session_id, term, count(*) AS qtf, length(term) >= 2 AND term NOT IN {sqltext.STOPWORDS} AS content
  FROM (SELECT qid, session_id, unnest({sqltext.tokens("text")}) AS term FROM asked) GROUP BY ALL
),
wanted AS (SELECT * FROM qtok JOIN terms USING (session_id, term)),
mass AS (SELECT qid, sum(idf) AS mass FROM wanted WHERE content GROUP BY ALL),
scored AS (
  SELECT w.qid, w.session_id, p.chunk_id,
         sum(w.qtf * w.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(k.t) / s.avgdl))) AS bm25,
         sum(CASE WHEN w.content THEN w.idf ELSE 0 END) / max(CASE WHEN coalesce(m.mass, 0) = 0 THEN 1 ELSE m.mass END) AS coverage
  FROM wanted w JOIN post p USING (session_id, term) JOIN tok k USING (session_id, chunk_id) JOIN sums s USING (session_id) LEFT JOIN mass m USING (qid)
  GROUP BY ALL
),
every AS (
  SELECT a.qid, c.chunk_id, coalesce(s.bm25, 0) AS bm25, coalesce(s.coverage, 0) AS coverage
  FROM asked a JOIN chunks c USING (session_id) LEFT JOIN scored s ON s.qid = a.qid AND s.chunk_id = c.chunk_id
),
lexrank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 10) DESC, chunk_id) AS rank FROM every)"""

_ALL_DOCS = f"""chunks AS (SELECT lang AS session_id, doc_id AS chunk_id, text FROM documents),
asked AS (SELECT item_id || '/' || lang AS qid, lang AS session_id, text FROM benchmark, (SELECT DISTINCT lang FROM documents)),"""

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

_KNN = f"""near AS (
  SELECT q.vec_id AS qid, c.vec_id AS chunk_id, c.label AS source, {_DOT.format(a="q.embedding", b="c.embedding")} AS sim
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 10) DESC, chunk_id) AS rank FROM near)"""

_HYBRID = f"""chunks AS (
  SELECT d.lang AS session_id, d.doc_id AS chunk_id, d.source, d.text, {sqltext.numeric_heavy("coalesce(d.text, '')")} AS numeric_heavy, e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
),
asked AS (
  SELECT b.item_id || '/' || s.lang AS qid, s.lang AS session_id, b.text, e.embedding
  FROM benchmark b CROSS JOIN (SELECT DISTINCT lang FROM documents) s LEFT JOIN embeddings e ON e.vec_id = b.item_id * 50
),{_LEXICAL},{_SCORED},
sims AS (
  SELECT a.qid, c.chunk_id, {_DOT.format(a="a.embedding", b="c.embedding")} AS sim FROM asked a JOIN chunks c USING (session_id)
  WHERE a.embedding IS NOT NULL AND c.embedding IS NOT NULL
),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 10) DESC, chunk_id) AS rank FROM sims),
fused0 AS (
  SELECT qid, chunk_id, d.rank AS d_rank, l.rank AS l_rank, l.coverage,
         coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS rrf
  FROM (SELECT * FROM dense WHERE rank <= 24) d FULL JOIN (SELECT * FROM lexrank WHERE rank <= 24) l USING (qid, chunk_id)
),
found AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.qid ORDER BY round(rrf, 12) DESC, d_rank ASC NULLS LAST, l_rank ASC NULLS LAST) AS fused,
         coalesce(round(s.sim, 4), 0) AS raw_score, coalesce(f.coverage, 0) AS support, c.source, c.numeric_heavy, c.text
  FROM fused0 f LEFT JOIN sims s USING (qid, chunk_id) JOIN chunks c USING (chunk_id)
),
routed AS (
  SELECT *, avg(CAST(numeric_heavy AS INT)) OVER (PARTITION BY qid) AS numeric_share, count(*) OVER (PARTITION BY qid) AS n_candidates,
         CASE WHEN raw_score >= 0.4 THEN 'dense' WHEN raw_score >= 0.25 AND round(support, 10) >= 0.5 THEN 'both'
              WHEN round(support, 10) >= 0.5 AND raw_score >= 0.12 THEN 'lexical' END AS route
  FROM found
),
damped AS (
  SELECT *, numeric_heavy AND numeric_share < 0.8 AND route IS NOT NULL AS damped,
         CASE WHEN numeric_heavy AND numeric_share < 0.8 AND route IS NOT NULL THEN round(raw_score * 0.5, 4) ELSE raw_score END AS score
  FROM routed
),
floored AS (
  SELECT *, greatest(0.25, max(CASE WHEN route IS NOT NULL THEN score END) OVER (PARTITION BY qid) * 0.5) AS eff,
         count(route) OVER (PARTITION BY qid) AS n_admitted
  FROM damped
),
judged AS (
  SELECT *, route IS NOT NULL AND score >= CASE WHEN route = 'lexical' THEN 0.12 ELSE eff END AS passed FROM floored
),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY fused) AS within FROM judged WHERE passed),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(within > 3 AS INT), fused) AS place FROM kept) WHERE place <= 6
)"""

SQL = {
    "term_df_idf": f"WITH {_ALL_DOCS}{_LEXICAL} SELECT session_id, term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {_ALL_DOCS}{_LEXICAL},{_SCORED} SELECT qid, chunk_id, rank, round(bm25, 5) AS bm25, round(coverage, 5) AS coverage FROM lexrank WHERE rank <= 6",
    "query_coverage": f"WITH {_ALL_DOCS}{_LEXICAL},{_SCORED} SELECT qid, chunk_id, round(coverage, 6) AS coverage FROM scored WHERE round(coverage, 6) >= 0.5",
    "knn_cosine_topk": f"WITH {_KNN} SELECT qid, chunk_id, rank, round(sim, 4) AS score FROM ranked WHERE rank <= 24",
    "source_cap_backfill": f"""WITH {_KNN}, held AS (
  SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS within FROM ranked WHERE rank <= 24
), placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(within > 3 AS INT), rank) AS place FROM held)
SELECT qid, chunk_id, CAST(source AS BIGINT) AS source, rank, place FROM placed WHERE place <= 6""",
    "rrf_fusion": f"WITH {_HYBRID} SELECT qid, chunk_id, d_rank, l_rank, fused, round(rrf, 8) AS rrf, raw_score FROM found",
    "admission_routes": f"""WITH {_HYBRID} SELECT qid, count(*) FILTER (route = 'dense') AS n_dense, count(*) FILTER (route = 'both') AS n_both,
  count(*) FILTER (route = 'lexical') AS n_lexical, count(*) FILTER (route IS NULL) AS n_dropped, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS n_passed
FROM judged GROUP BY qid""",
    "hybrid_search": f"WITH {_HYBRID} SELECT qid, place, chunk_id, source, route, score, raw_score, round(support, 5) AS support FROM hits",
    "search_summary": f"""WITH {_HYBRID}, t AS (
  SELECT qid, max(n_candidates) AS n_candidates, max(n_admitted) AS n_admitted, max(eff) AS eff, sum(CAST(passed AS INT)) AS n_passed,
         round(max(numeric_share), 4) AS numeric_share, bool_or(damped) AS damped FROM judged GROUP BY qid
), r AS (SELECT qid, count(*) AS returned, max(score) AS best FROM hits GROUP BY qid)
SELECT a.qid, coalesce(returned, 0) AS returned, coalesce(best, 0) AS best_score,
       CAST(coalesce(CASE WHEN coalesce(returned, 0) > 0 THEN n_passed ELSE n_candidates END, 0) AS BIGINT) AS considered,
       CASE WHEN n_candidates IS NULL THEN 0 WHEN n_admitted = 0 THEN 0.25 ELSE round(eff, 6) END AS floor_applied,
       coalesce(numeric_share, 0) AS numeric_share, coalesce(damped, false) AS damped,
       CASE WHEN n_candidates IS NULL THEN 'dense' ELSE 'hybrid' END AS mode,
       CASE WHEN coalesce(returned, 0) = 0 THEN 'none' WHEN best >= 0.5 THEN 'high' WHEN best >= 0.35 THEN 'medium' ELSE 'low' END AS confidence,
       CASE WHEN coalesce(returned, 0) > 0 THEN 'answer' ELSE 'no_match' END AS verdict
FROM asked a LEFT JOIN t USING (qid) LEFT JOIN r USING (qid)""",
    "rerank_tiers": f"""WITH {_HYBRID}, m AS (
  SELECT f.qid, f.chunk_id, f.fused, round(len(list_intersect(string_split(lower(a.text), ' '), string_split(lower(f.text), ' ')))::DOUBLE
         / greatest(len(string_split(lower(f.text), ' ')), 1), 8) AS s FROM found f JOIN asked a USING (qid)
), p AS (SELECT *, CASE WHEN fused <= 20 THEN s END AS score FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, fused) AS best FROM p),
t AS (SELECT *, CASE WHEN best <= 10 AND score IS NOT NULL THEN 0 WHEN fused <= 20 THEN 1 ELSE 2 END AS tier FROM b)
SELECT qid, chunk_id, fused, row_number() OVER (PARTITION BY qid ORDER BY tier, CASE WHEN tier = 0 THEN best ELSE fused END) AS "order" FROM t""",
}
