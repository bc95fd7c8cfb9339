"""Label drafting and chunker comparison over ``documents`` and ``benchmark``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import DEFAULTS
from tessellar.functions.text import normalised
from tessellar.operators import drafting
from tessellar.operators.evaluation import contained_facts
from tessellar.plans import sqltext
from tessellar.sources import chunking
from tessellar.work import spread

# fixed values: the settings that are compared (size, overlap)
SETTINGS = ((300, 50), (450, 75), (600, 100), (900, 150), (1200, 200), (1600, 266))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))


def document_idf(spark: SparkSession, sf: str) -> DataFrame:
    return drafting.document_idf(_lines(spark, sf)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def evidence_spans(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(drafting.reads_like_evidence(F.col("text"), F.lit("")), 1)).alias("evidence")
    )


def drafted_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps in records that are rendered as settings: a nation's customers with their balances."""
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    text = F.concat(F.translate("c_name", "#", " "), F.lit(": "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return drafting.blanks(rows.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("pos"), text.alias("text")))


def chunker_bakeoff(spark: SparkSession, sf: str) -> DataFrame:
    """For each setting: chunks, and how many (passage, document) pairs keep the passage whole in one chunk."""
    docs = _docs(spark, sf)
    facts = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("fact_id"), "text")
    held = contained_facts(facts, docs)
    named = held.join(facts.select("fact_id", normalised(F.col("text")).alias("fact")), "fact_id")
    blocks = docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.lit(0).alias("pos"), F.lit(0).alias("page"), F.lit("").alias("heading"), F.lit(0).alias("start"), "text"
    )
    out = None
    for size, overlap in SETTINGS:
        chunks = chunking.chunk_blocks(blocks, replace(DEFAULTS, chunk_size=size, chunk_overlap=overlap, embed_max_tokens=0))
        whole = named.join(chunks.select("doc_id", normalised(F.col("text")).alias("body")), "doc_id").where(F.contains("body", F.col("fact")))
        intact = whole.select("fact_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("intact"))
        row = (
            chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(held.agg(F.count(F.lit(1)).alias("pairs"))).crossJoin(intact)
            .select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "chunks", "pairs", "intact")
        )
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (document_idf, evidence_spans, drafted_gaps, chunker_bakeoff)}

_LINES = """lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)"""
_PAIR = r"^\s*([A-Za-z$][\w .$\[\]-]{0,59}?)\s*[:=]\s*(\S.{0,79}?)\s*$"

SQL = {
    "document_idf": f"""WITH {_LINES}, t AS (
  SELECT doc_id, pos, unnest(list_distinct(list_filter({sqltext.tokens("text")}, lambda t: length(t) >= 2 AND t NOT IN {sqltext.STOPWORDS}))) AS term FROM lines),
n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, term, round(ln(1 + max(n) / (1 + count(*))), 6) AS weight FROM t JOIN n USING (doc_id) GROUP BY doc_id, term""",
    "evidence_spans": rf"""WITH {_LINES}, w AS (SELECT *, len(regexp_split_to_array(trim(text), '\s+')) AS words FROM lines)
SELECT doc_id, count(*) AS n, count(*) FILTER (length(text) >= {drafting.LEAST_FACT} AND NOT regexp_matches(text, '^\s*(//|#|--|/\*|\*)') AND (
  (regexp_matches(text, '[0-9]') AND regexp_matches(text, '[:=]')) OR regexp_matches(rtrim(text), '[;{{]$') OR contains(text, '=')
  OR NOT (words <= 3 OR (words <= 8 AND NOT regexp_matches(text, '[.!?]$') AND NOT regexp_matches(text, '[0-9]'))))) AS evidence FROM w GROUP BY doc_id""",
    "drafted_gaps": rf"""WITH lines AS (SELECT c_nationkey AS doc_id, c_custkey AS pos, replace(c_name, '#', ' ') || ': ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS text FROM customer),
p AS (SELECT doc_id, pos, regexp_extract(text, '{_PAIR}', 1) AS key, regexp_extract(text, '{_PAIR}', 2) AS value FROM lines),
o AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(key)) AS k, count(*) OVER (PARTITION BY doc_id, lower(value)) AS v FROM p WHERE key <> '' AND length(value) > 1)
SELECT doc_id, pos, key || ': ____' AS question, value AS answer FROM o WHERE k = 1 AND v = 1 AND NOT contains(lower(key), lower(value))""",
}
