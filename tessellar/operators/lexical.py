"""Lexical index and BM25 scoring, per session.

The index is three tables: ``postings(session_id, chunk_id, term, tf, dl)``,
``sums(session_id, n, avgdl)`` and ``terms(session_id, term, df, idf)``, written once by an
``IndexStore`` and read by every search until the session's chunks change.
Searches take a DataFrame of queries (``qid, session_id, text``) and run as one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.config import DEFAULTS, Settings
from tessellar.functions.text import content_terms, tokens
from tessellar.work import delete, exists

#: Queries whose terms or vectors are broadcast; beyond it they are shuffled.
MOST_BROADCAST = 10_000


@dataclass
class LexicalIndex:
    postings: DataFrame
    sums: DataFrame
    terms: DataFrame


def asked_few(queries: DataFrame) -> bool:
    """Whether the queries are few enough for their terms and vectors to be broadcast."""
    return queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _postings(chunks: DataFrame) -> DataFrame:
    """``session_id, chunk_id, term, tf, dl``: the tokens of each chunk counted, and how many it has."""
    found = chunks.select("session_id", "chunk_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    terms = found.select("session_id", "chunk_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    # chunks dealt by id need no shuffle for this
    return terms.groupBy("session_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def build_index(chunks: DataFrame) -> LexicalIndex:
    """Index ``chunks(session_id, chunk_id, text)``; idf and average length are those of the session.

    Nothing is kept: each use of a table makes it again. ``IndexStore`` writes them once.
    """
    held = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return _with_terms(_postings(chunks), held)


def _with_terms(postings: DataFrame, held: DataFrame) -> LexicalIndex:
    """The index of ``postings`` for sessions of ``held(session_id, n)`` chunks."""
    lengths = postings.groupBy("session_id").agg(F.sum("tf").alias("all"))
    sums = held.join(lengths, "session_id").select("session_id", "n", (F.col("all") / F.col("n")).alias("avgdl"))
    terms = (
        postings.groupBy("session_id", "term")
        .agg(F.count("tf").alias("df"))
        .join(sums, "session_id")
        .select("session_id", "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    )
    return LexicalIndex(postings, sums, terms)


class IndexStore:
    """Written indexes under ``path``, a folder for each session, good as long as the session's chunks are as many.

    ``index`` builds what is missing or has changed and leaves the other sessions alone;
    ``invalidate`` makes the next call build sessions again whose texts changed in place.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_id: str = "long", session_id: str = "string"):
        self.spark, self.path = spark, path
        key = f"session_id {session_id}"
        self.schemas = {
            "postings": f"chunk_id {chunk_id}, term string, tf long, dl long, {key}",
            "sums": f"n long, avgdl double, {key}",
            "terms": f"term string, df long, idf double, {key}",
        }

    def _read(self, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], T._parse_datatype_string(self.schemas[name]))
        return self.spark.read.schema(self.schemas[name]).parquet(where)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{self.path}/{name}")

    def index(self, chunks: DataFrame) -> LexicalIndex:
        """The index of ``chunks(session_id, chunk_id, text)``."""
        held = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        stale = held.join(self._read("sums").select("session_id", "n"), ["session_id", "n"], "left_anti")
        if not stale.isEmpty():
            part = chunks.join(F.broadcast(stale.select("session_id")), "session_id", "left_semi")
            self._write(build_index(part).postings.sortWithinPartitions("session_id", "term"), "postings")
            built = _with_terms(self._read("postings").join(F.broadcast(stale.select("session_id")), "session_id", "left_semi"), held)
            self._write(built.terms, "terms")
            # last, as it is what says that a session is indexed
            self._write(built.sums, "sums")
        return LexicalIndex(self._read("postings"), self._read("sums"), self._read("terms"))

    def invalidate(self, *sessions: str) -> None:
        """Forget the sessions' indexes."""
        for session in sessions:
            for name in reversed(self.schemas):
                delete(self.spark, f"{self.path}/{name}/session_id={session}")


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, session_id, term, qtf, content``: tokens with repeats and stopwords, and which of them carry content."""
    every = queries.select("qid", "session_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "session_id", "term").agg(
        F.count(F.lit(1)).alias("qtf")
    )
    content = queries.select("qid", F.explode(content_terms(F.col("text"))).alias("term"), F.lit(True).alias("content"))
    return every.join(content, ["qid", "term"], "left").withColumn("content", F.coalesce("content", F.lit(False)))


def score(index: LexicalIndex, queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``qid, session_id, chunk_id, bm25, coverage`` of every chunk that has a query term.

    Coverage is the idf mass of the query's content terms that the chunk has, over that
    of all of them (unknown terms weigh nothing; no mass counts as 1).
    """
    wanted = query_terms(queries).join(index.terms, ["session_id", "term"])
    mass = wanted.where("content").groupBy("qid").agg(F.sum("idf").alias("mass"))
    if asked_few(queries):
        wanted = F.broadcast(wanted)
    matched = index.postings.join(wanted, ["session_id", "term"]).join(index.sums, "session_id")
    norm = F.col("tf") + settings.k1 * (1 - settings.b + settings.b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (settings.k1 + 1) / norm
    scored = matched.groupBy("qid", "session_id", "chunk_id").agg(
        F.sum(part).alias("bm25"), F.sum(F.when(F.col("content"), F.col("idf")).otherwise(0.0)).alias("covered")
    )
    whole = F.when(F.coalesce("mass", F.lit(0.0)) == 0, 1.0).otherwise(F.col("mass"))
    return scored.join(mass, "qid", "left").select("qid", "session_id", "chunk_id", "bm25", (F.col("covered") / whole).alias("coverage"))


def top(scored: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` chunks of each query, chunks without a match after all others, by id.

    Fewer matches than ``limit`` leave room for chunks without one; the session's first
    ``2 * limit`` chunks always hold enough of them, so no query meets all chunks.
    """
    by_id = W.partitionBy("session_id").orderBy("chunk_id")
    spare = chunks.select("session_id", "chunk_id", F.row_number().over(by_id).alias("rn")).where(F.col("rn") <= 2 * limit).drop("rn")
    fill = queries.select("qid", "session_id").join(spare, "session_id").join(scored.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    both = scored.select("qid", "session_id", "chunk_id", "bm25", "coverage").unionByName(
        fill.select("qid", "session_id", "chunk_id", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("coverage"))
    )
    # the tenth digit decides no order that adding up in another sequence could change
    best = W.partitionBy("qid").orderBy(F.round("bm25", 10).desc(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
