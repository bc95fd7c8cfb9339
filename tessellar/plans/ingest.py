"""Ingest queries: pages and documents to blocks and chunks, and what chunking did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.sources import chunking, parsers
from tessellar.work import spread


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet"))
    return pages.select(F.col("page_id").alias("doc_id"), F.lit("page.html").alias("path"), F.col("html").cast("binary").alias("content"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    files = docs.select("doc_id", F.lit("note.txt").alias("path"), F.col("text").cast("binary").alias("content"))
    return parsers.read_files(files)


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.read_files(_pages(spark, sf))


def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.read_chunks(_pages(spark, sf))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_blocks(chunking.with_offsets(_documents(spark, sf).where("status = 'ok'")))


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.ingest_stats(document_chunks(spark, sf), "doc_id")


QUERIES = {f.__name__: f for f in (page_blocks, page_chunks, document_chunks, ingest_stats)}
SQL: dict[str, str] = {}
