"""Vectors of texts where no model is at hand: hashed token counts, scaled to length 1. Native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellar.functions.text import tokens


def hashed_embedding(text: Column, dimensions: int = 384) -> Column:
    """Each token adds 1 to the dimension its hash picks; a text without tokens has a zero vector."""
    at = F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(at, lambda x: x == d)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
