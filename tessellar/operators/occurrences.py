"""Every place a term occurs, with spans, caps that are part of the answer, and the full count."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.config import DEFAULTS
from tessellar.functions.text import phrase_pattern, spans, utf16_length


def without_overlap(found: DataFrame) -> DataFrame:
    """Drop matches that lie wholly in the part a chunk shares with the chunk before it.

    ``found`` has every chunk that matched, with ``source, position, char_start,
    char_end, text, spans``. Without offsets the shared part is the longest end of the
    one, up to 600 characters, that begins the other.
    """
    before = F.lag(F.struct("position", "char_start", "char_end", "text")).over(W.partitionBy("source").orderBy("position"))
    known = F.col("before.char_end").isNotNull() & F.col("before.char_start").isNotNull() & F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    by_offset = F.when(
        (F.col("char_start") < F.col("before.char_end")) & (F.col("before.char_start") <= F.col("char_start")), F.col("before.char_end") - F.col("char_start")
    ).otherwise(0)
    longest = F.least(F.length("text"), F.length("before.text"), F.lit(600))
    sizes = F.when(longest > 0, F.sequence(longest, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    by_text = F.coalesce(
        F.element_at(F.filter(sizes, lambda n: F.endswith(F.col("before.text"), F.substring(F.col("text"), F.lit(1), n))), 1), F.lit(0)
    )
    shared = (
        F.when(F.col("before").isNull(), 0).when(known, by_offset).when(F.col("position") == F.col("before.position") + 1, by_text).otherwise(0)
    )
    return (
        found.withColumn("before", before)
        .withColumn("shared", shared)
        .withColumn("spans", F.filter("spans", lambda s: (F.col("shared") <= 0) | (s["end"] > F.col("shared"))))
        .drop("before", "shared")
    )


def find(chunks: DataFrame, term: str, limit: int = DEFAULTS.occurrence_chunks, each: int = DEFAULTS.occurrence_spans) -> DataFrame:
    """``chunks(name, source, position, text, char_start, char_end)`` that hold the term, by name, source and position.

    ``total`` counts all matches, ``truncated`` tells that there are more chunks than
    ``limit``; ``matches`` are the first spans of a chunk, in UTF-16 units.
    """
    pattern = phrase_pattern(term)
    if pattern is None:
        return chunks.limit(0).select("name", "source", "position")
    first = re.split(r"[\s\-‐-―]+", term.strip())[0] or term.strip()
    escaped = re.sub(r"([\\%_])", r"\\\1", first)
    matched = chunks.where(F.col("text").ilike(f"%{escaped}%")).withColumn("spans", spans(F.col("text"), f"(?iU){pattern}"))
    held = without_overlap(matched).where(F.size("spans") > 0)
    place = F.row_number().over(W.orderBy("name", "source", "position"))
    totals = held.agg(F.sum(F.size("spans")).alias("total"), F.count(F.lit(1)).alias("n_chunks"))
    best = held.orderBy("name", "source", "position").limit(limit).withColumn("place", place)
    unit = lambda at: utf16_length(F.substring(F.col("text"), F.lit(1), at))
    return best.crossJoin(totals).select(
        "place", "name", "source", "position",
        F.size("spans").alias("count"),
        F.transform(F.slice("spans", 1, each), lambda s: F.concat(unit(s["start"]), F.lit(":"), unit(s["end"]))).alias("matches"),
        (F.size("spans") > each).alias("more"),
        "total",
        (F.col("n_chunks") > limit).alias("truncated"),
    )
