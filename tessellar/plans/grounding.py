"""Grounding queries: replies of ``conversations`` against the turns before them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions import answers, grounding
from tessellar.work import spread


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn as an answer that cites the turn before it as [1] and one that does not exist."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("passage", before).where("role = 'assistant'")
    # an answer's id from its conversation and turn
    return rows.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("qid"), F.concat("text", F.lit(" [1] [9]")).alias("raw"), "passage", "text")


def grounded_replies(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf)
    passages = replies.where(F.col("passage").isNotNull()).select("qid", F.lit(1).alias("n"), F.concat_ws(" ", "passage", "text").alias("text"))
    return grounding.ground(replies.select("qid", "raw"), passages)


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf)
    return answers.score_answers(
        replies.select("qid", F.col("raw").alias("answer"), F.array("passage").alias("passages"), F.array("text").alias("facts"), F.array("text").alias("expected"))
    )


def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every document with their spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, a, b) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for a, b in grounding.sentence_spans(t or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start", "end"])

    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text")
    return docs.mapInArrow(cut, "doc_id long, start int, end int")


def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    """Generation summary: replies by kind, with mean support of their claims."""
    scores = answer_scores(spark, sf)
    return scores.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("substance"), 6).alias("substance")
    )


def _customer_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A passage of three sentences for each customer."""
    where = F.concat(F.lit("Customer number "), "c_custkey", F.lit(" lives in nation "), "c_nationkey", F.lit("."))
    segment = F.concat(F.lit("Segment of the customer is "), "c_mktsegment", F.lit("."))
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("qid"), "c_mktsegment", where.alias("place"), segment.alias("segment"))


def cited_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """What is marked in each customer's passage: a quote over a sentence's end where the answer brings
    one, else the sentence most like the claim."""
    notes = _customer_notes(spark, sf)
    quoted = F.concat(F.lit('It says so [1].\n\nQUOTES:\n[1] "customer is '), "c_mktsegment", F.lit('. Nothing  else"'))
    matched = F.concat(F.lit("No doubt. The segment of this customer is "), "c_mktsegment", F.lit(" [1]."))
    answers_ = notes.select("qid", F.when(F.col("qid") % 2 == 1, quoted).otherwise(matched).alias("raw"))
    passages = notes.select("qid", F.lit(1).alias("n"), F.concat_ws(" ", "place", "segment", F.lit("Nothing else is known here.")).alias("text"))
    found = grounding.ground(answers_, passages)
    return found.select("qid", "n", "source", F.array_join("starts", ",").alias("starts"), F.array_join("ends", ",").alias("ends"))


def answer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a right answer, a wrong one and none, for each third of the customers."""
    notes = _customer_notes(spark, sf)
    right = F.concat(F.lit("Segment of the customer is "), "c_mktsegment", F.lit(" [2]."))
    wrong = F.lit("Unknown wholly different matters [1]. More follows.")
    answer = F.when(F.col("qid") % 3 == 0, right).when(F.col("qid") % 3 == 1, wrong).otherwise("")
    return answers.score_answers(
        notes.select("qid", answer.alias("answer"), F.array("place", "segment").alias("passages"), F.array("c_mktsegment").alias("facts"), F.array("c_mktsegment").alias("expected"))
    )


QUERIES = {f.__name__: f for f in (grounded_replies, answer_scores, sentence_units, claim_support, cited_quotes, answer_checks)}

SQL = {
    "cited_quotes": """WITH c AS (SELECT c_custkey AS qid, c_mktsegment AS s, length('Customer number ' || c_custkey || ' lives in nation ' || c_nationkey || '.') + 1 AS b FROM customer)
SELECT qid, 1 AS n, CASE WHEN qid % 2 = 1 THEN 'model' ELSE 'matcher' END AS source,
  CAST(CASE WHEN qid % 2 = 1 THEN b + length('Segment of the ') ELSE b END AS VARCHAR) AS starts,
  CAST(b + length('Segment of the customer is ' || s || '.') + CASE WHEN qid % 2 = 1 THEN length(' Nothing else') ELSE 0 END AS VARCHAR) AS ends FROM c""",
    "answer_checks": """SELECT c_custkey AS qid, CAST(k = 0 AS INT)::DOUBLE AS faithfulness, CAST(k < 2 AS INT) AS cited_claims, CAST(k = 0 AS INT) AS grounded,
  CAST(k < 2 AS INT)::DOUBLE AS citation_precision, CAST(k = 0 AS INT)::DOUBLE AS relevancy, CAST(k = 0 AS INT)::DOUBLE AS substance, CAST(k = 0 AS INT)::DOUBLE AS verbatim,
  ['complete', 'missed', 'refused'][k + 1] AS kind, CASE WHEN k = 0 THEN 'exact' ELSE 'none' END AS key, CAST(k = 1 AS INT) AS uncited
FROM (SELECT c_custkey, c_custkey % 3 AS k FROM customer)""",
}
