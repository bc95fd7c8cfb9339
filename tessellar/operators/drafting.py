"""Drafting labels from documents: spans that read like evidence, ranked for a question; gaps to fill.

Per-document weights: a term is worth less the more spans of its document have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.text import content_terms, normalised

#: Characters of the shortest fact.
LEAST_FACT = 12


def document_idf(spans: DataFrame) -> DataFrame:
    """``doc_id, term, weight`` over ``spans(doc_id, pos, text)``: ln(1 + n / (1 + df))."""
    terms = spans.select("doc_id", "pos", F.explode(content_terms(F.coalesce("text", F.lit("")))).alias("term"))
    df = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "doc_id").select("doc_id", "term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("weight"))


def rank_spans(spans: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, doc_id, pos, overlap, rank``: a question's spans in its document by the weight of shared terms, then place."""
    wanted = questions.select("qid", "doc_id", F.explode(content_terms(F.col("text"))).alias("term"))
    terms = spans.select("doc_id", "pos", F.explode(content_terms(F.coalesce("text", F.lit("")))).alias("term"))
    shared = wanted.join(terms, ["doc_id", "term"]).join(document_idf(spans), ["doc_id", "term"])
    scored = shared.groupBy("qid", "doc_id", "pos").agg(F.round(F.sum("weight"), 9).alias("overlap"))
    best = W.partitionBy("qid", "doc_id").orderBy(F.col("overlap").desc(), "pos")
    return scored.withColumn("rank", F.row_number().over(best))


def reads_like_evidence(span: Column, heading: Column) -> Column:
    """A value with its key, a statement, or words enough for a claim; not a title, a comment or a stub."""
    words = F.size(F.split(F.trim(span), r"\s+"))
    echoes = F.exists(F.split(F.coalesce(heading, F.lit("")), r"\s*>\s*"), lambda h: (F.trim(h) != "") & (normalised(h) == normalised(span)))
    keyed = span.rlike("[0-9]") & span.rlike("[:=]")
    states = F.rtrim(span).rlike(r"[;{]$") | F.contains(span, F.lit("="))
    label = (words <= 3) | ((words <= 8) & ~span.rlike("[.!?]$") & ~span.rlike("[0-9]"))
    return (F.length(span) >= LEAST_FACT) & ~span.rlike(r"^\s*(//|#|--|/\*|\*)") & ~echoes & (keyed | states | ~label)


def blanks(spans: DataFrame) -> DataFrame:
    """Questions with a gap from ``key: value`` spans whose key and value are each one in their document.

    ``doc_id, pos, question, answer``; a value that its key holds, or of one letter, is no answer.
    """
    key, value = F.regexp_extract("text", r"^\s*([A-Za-z$][\w .$\[\]-]{0,59}?)\s*[:=]\s*(\S.{0,79}?)\s*$", 1), F.regexp_extract(
        "text", r"^\s*([A-Za-z$][\w .$\[\]-]{0,59}?)\s*[:=]\s*(\S.{0,79}?)\s*$", 2
    )
    pairs = spans.select("doc_id", "pos", key.alias("key"), value.alias("value")).where((F.col("key") != "") & (F.length("value") > 1))
    by_key, by_value = W.partitionBy("doc_id", F.lower("key")), W.partitionBy("doc_id", F.lower("value"))
    once = pairs.withColumn("k", F.count(F.lit(1)).over(by_key)).withColumn("v", F.count(F.lit(1)).over(by_value))
    told = F.contains(F.lower("key"), F.lower(F.col("value")))
    return once.where((F.col("k") == 1) & (F.col("v") == 1) & ~told).select(
        "doc_id", "pos", F.concat("key", F.lit(": ____")).alias("question"), F.col("value").alias("answer")
    )


def review(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with the verdicts of a reader: ``verdicts(id, verified, fact)``; a fact replaces the drafted ones."""
    read = verdicts.select("id", F.col("verified").alias("_v"), F.col("fact").alias("_f"))
    joined = items.join(read, "id", "left")
    facts = F.when(F.col("_f").isNotNull(), F.array("_f")).otherwise(F.col("required_facts"))
    return joined.withColumn("required_facts", facts).withColumn("verified_by_human", F.coalesce("_v", "verified_by_human")).drop("_v", "_f")


def reanchored(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, positions``: where the facts of each item are now, in the chunks of its source."""
    facts = items.select("id", "source", F.explode("required_facts").alias("fact"))
    held = facts.join(chunks.select("source", "position", "text"), "source").where(
        F.contains(normalised(F.coalesce("text", F.lit(""))), normalised(F.col("fact")))
    )
    return held.groupBy("id").agg(F.array_sort(F.collect_set("position")).alias("positions"))
