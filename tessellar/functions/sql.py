"""Names under which SQL can call the text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellar.functions import grounding
from tessellar.functions.text import SEARCH_STOPWORDS
from tessellar.sources import chunking


#: ``functions.text.tokens`` in SQL.
_TOKENS = """concat(
  filter(transform(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1), w -> lower(w)), w -> length(w) > 1),
  flatten(transform(filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1), w -> w RLIKE '_|.[A-Z]'),
    w -> filter(transform(regexp_extract_all(w, '([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)', 1), p -> lower(p)), p -> length(p) > 1 AND p <> lower(w)))),
  transform(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)+|[0-9]+)', 1), n -> replace(n, ',', '')))"""


def register_all(spark: SparkSession) -> list[str]:
    """Register ``ts_chunk_spans(text, size, overlap)``, ``ts_fold(text)``, ``ts_sentences(text)``,
    ``ts_numeric_heavy(text)``, ``ts_tokens(text)`` and ``ts_content_terms(text)`` with the session; returns their names.

    They run in Arrow batches; where a native expression exists (``functions.text``) prefer it.
    """
    spans = "array<struct<start:int,end:int>>"

    @F.pandas_udf(spans)
    def chunk_spans(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        rows = zip(text.fillna(""), size, overlap, strict=True)
        return pd.Series([[{"start": a, "end": b} for a, b in chunking.spans(t, int(s), int(o))] for t, s, o in rows])

    @F.pandas_udf("string")
    def fold(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: grounding.folded(t)[0])

    @F.pandas_udf(spans)
    def sentences(text: pd.Series) -> pd.Series:
        return text.fillna("").map(lambda t: [{"start": a, "end": b} for a, b in grounding.sentence_spans(t)])

    @F.pandas_udf("boolean")
    def numeric_heavy(text: pd.Series) -> pd.Series:
        return text.fillna("").map(chunking.numeric_heavy)

    # the native expressions, as SQL functions: they are inlined into the plan and run in the JVM
    stop = ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ts_tokens(text STRING) RETURNS ARRAY<STRING> RETURN {_TOKENS}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ts_content_terms(text STRING) RETURNS ARRAY<STRING> "
        f"RETURN array_distinct(filter({_TOKENS}, t -> length(t) >= 2 AND NOT array_contains(array({stop}), t)))"
    )

    made = {"ts_chunk_spans": chunk_spans, "ts_fold": fold, "ts_sentences": sentences, "ts_numeric_heavy": numeric_heavy}
    for name, function in made.items():
        spark.udf.register(name, function)
    return [*made, "ts_tokens", "ts_content_terms"]
