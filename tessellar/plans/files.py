"""Parsers and chunk windows, on files rendered from the tables; the SQL builds the blocks that they should become."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.config import DEFAULTS
from tessellar.functions.text import numeric_heavy
from tessellar.plans import sqltext
from tessellar.sources import chunking, parsers
from tessellar.work import spread


def _in_order(key: str, value: Column) -> Column:
    """The values of a group in the order of ``key``."""
    return F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value"))))["value"]


def _blocks(files: DataFrame) -> DataFrame:
    return parsers.read_files(files).select("doc_id", "pos", "heading", "text")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet")


def csv_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file of customers for each nation: pairs of column and value, packed into blocks."""
    row = F.concat_ws(",", "c_custkey", "c_name")
    files = _customers(spark, sf).groupBy(F.col("c_nationkey").alias("doc_id")).agg(
        F.concat(F.lit("key,name\n"), F.array_join(_in_order("c_custkey", row), "\n")).alias("content")
    )
    return _blocks(files.select("doc_id", F.lit("customers.csv").alias("path"), "content"))


def json_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON file of customers for each nation: leaves with their paths, of the list its first 200 members."""
    row = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    files = _customers(spark, sf).groupBy(F.col("c_nationkey").alias("doc_id")).agg(_in_order("c_custkey", row).alias("customers"))
    content = F.to_json(F.struct(F.col("doc_id").alias("nation"), "customers"))
    return _blocks(files.select("doc_id", F.lit("customers.json").alias("path"), content.alias("content")))


def settings_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """An INI file of customers for each nation, a section each: settings with their paths."""
    row = F.concat(F.lit("[c"), "c_custkey", F.lit("]\nName = "), "c_name", F.lit("\nnation="), "c_nationkey", F.lit("\n"))
    files = _customers(spark, sf).groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.array_join(_in_order("c_custkey", row), "\n").alias("content"))
    return _blocks(files.select("doc_id", F.lit("customers.ini").alias("path"), "content"))


def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown file for each region, a heading, a sentence and a table for each nation: text and rows under their headings."""
    part = F.concat(
        F.lit("## "), "n_name", F.lit("\n\nNation number "), "n_nationkey", F.lit(".\n\n| id | name |\n| --- | --- |\n| "), "n_nationkey",
        F.lit(" | "), "n_name", F.lit(" |\n"),
    )
    nations = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = nations.groupBy(F.col("r_regionkey").alias("doc_id"), "r_name").agg(F.array_join(_in_order("n_nationkey", part), "\n").alias("body"))
    content = F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "body")
    return _blocks(files.select("doc_id", F.lit("nations.md").alias("path"), content.alias("content")))


def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A Python file for each region, a class with a method for each nation: every definition under its dotted name."""
    method = F.concat(F.lit("    def nation_"), "n_nationkey", F.lit("(self):\n        return '"), "n_name", F.lit("'\n"))
    files = spark.read.parquet(f"{sf}/nation.parquet").groupBy(F.col("n_regionkey").alias("doc_id")).agg(_in_order("n_nationkey", method).alias("methods"))
    content = F.concat(F.lit("import os\n\n\nclass Region:\n"), F.array_join("methods", "\n"))
    return _blocks(files.select("doc_id", F.lit("region.py").alias("path"), content.alias("content")))


def _spans_of(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """``doc_id, n, start, end`` of every chunk window of ``texts(doc_id, text)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, n, a, b)
                for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for n, (a, b) in enumerate(chunking.spans(t, size, overlap))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n", "start", "end"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, n long, start long, end long")


def prose_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Windows over every document that is prose."""
    text = F.coalesce("text", F.lit(""))
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", text.alias("text")).where(~numeric_heavy(text))
    return _spans_of(docs, DEFAULTS.chunk_size, DEFAULTS.chunk_overlap)


def table_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Windows over a table of numbers for each supplier: whole lines, all long enough to count as numeric at any scale."""
    line = F.concat_ws(" ", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_partkey", "l_linenumber")
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("doc_id"), line.alias("line"))
    texts = items.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    return _spans_of(texts, DEFAULTS.chunk_size, DEFAULTS.chunk_overlap)


QUERIES = {
    f.__name__: f for f in (csv_blocks, json_blocks, settings_blocks, markdown_blocks, code_blocks, prose_spans, table_spans)
}


def _packed(lines: str, heading: str) -> str:
    """Blocks of at most the chunk size from ``lines(doc_id, i, line)``, i from 1."""
    return f"""WITH RECURSIVE lines AS ({lines}),
pack AS (
  SELECT doc_id, i, 0 AS pos, {DEFAULTS.chunk_size} - length(line) - 1 AS room FROM lines WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, p.pos + CAST(length(l.line) > p.room AS INT),
         CASE WHEN length(l.line) > p.room THEN {DEFAULTS.chunk_size} ELSE p.room END - length(l.line) - 1
  FROM pack p JOIN lines l ON l.doc_id = p.doc_id AND l.i = p.i + 1
)
SELECT doc_id, pos, '{heading}' AS heading, string_agg(line, chr(10) ORDER BY i) AS text FROM pack JOIN lines USING (doc_id, i) GROUP BY doc_id, pos"""


_PAIRS = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS i, line
  FROM (SELECT c_nationkey AS doc_id, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_name FROM customer), {fields}"""
_SIZE, _OVERLAP = DEFAULTS.chunk_size, DEFAULTS.chunk_overlap
_LAST = "CASE WHEN contains(w, {mark}) THEN length(regexp_extract(w, '(?s)^(.*){pattern}', 1)) ELSE -1 END"
_CUT = (
    "greatest(" + ", ".join(_LAST.format(mark=m, pattern=p) for m, p in (("chr(10) || chr(10)", "\\n\\n"), ("'. '", "\\. "), ("' '", " "))) + ")"
)
_END = f"CASE WHEN b + {_SIZE} >= length(text) THEN length(text) WHEN 2 * cut > {_SIZE} THEN b + cut + 1 ELSE b + {_SIZE} END"

SQL = {
    "csv_blocks": _packed(
        _PAIRS.format(order="k, f", fields="LATERAL (SELECT 1 AS f, 'key: ' || k AS line UNION ALL SELECT 2, 'name: ' || c_name)"), "columns: key, name"
    ),
    "json_blocks": _packed(
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, f) AS i, line FROM (
  SELECT doc_id, n, f, line FROM (SELECT c_nationkey AS doc_id, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_name FROM customer),
    LATERAL (SELECT 1 AS f, '$.customers[' || n || '].key: ' || k AS line UNION ALL SELECT 2, '$.customers[' || n || '].name: ' || c_name) WHERE n < 200
  UNION ALL SELECT DISTINCT c_nationkey, -1, 0, '$.nation: ' || c_nationkey FROM customer)""",
        "json: customers, nation",
    ),
    "settings_blocks": _packed(
        _PAIRS.format(order="k, f", fields="LATERAL (SELECT 1 AS f, '$.c' || k || '.name: ' || c_name AS line UNION ALL SELECT 2, '$.c' || k || '.nation: ' || doc_id)"),
        "config",
    ),
    "markdown_blocks": """SELECT r_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, f) - 1 AS INT) AS pos,
  r_name || ' > ' || n_name AS heading, text FROM nation JOIN region ON n_regionkey = r_regionkey,
  LATERAL (SELECT 1 AS f, 'Nation number ' || n_nationkey || '.' AS text UNION ALL SELECT 2, 'id: ' || n_nationkey || ' | name: ' || n_name)""",
    "code_blocks": """WITH m AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, '    def nation_' || n_nationkey || '(self):' || chr(10) || '        return ''' || n_name || '''' AS body FROM nation)
SELECT doc_id, 0 AS pos, 'Region' AS heading, 'Region' || chr(10) || 'class Region:' || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY k) AS text FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT), 'Region.nation_' || k, 'Region.nation_' || k || chr(10) || body FROM m""",
    "prose_spans": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE NOT {sqltext.numeric_heavy("coalesce(text, '')")} AND coalesce(text, '') <> ''),
w AS (
  SELECT doc_id, b, {_END} AS e FROM (SELECT *, {_CUT} AS cut FROM (SELECT doc_id, text, 0 AS b, left(text, {_SIZE}) AS w FROM d))
  UNION ALL
  SELECT doc_id, b, {_END} FROM (SELECT *, {_CUT} AS cut FROM (
    SELECT w.doc_id, d.text, greatest(w.b + 1, w.e - {_OVERLAP}) AS b, substr(d.text, greatest(w.b + 1, w.e - {_OVERLAP}) + 1, {_SIZE}) AS w
    FROM w JOIN d USING (doc_id) WHERE w.e < length(d.text)))
),
t AS (
  SELECT w.doc_id, b, e, length(text) AS total, substr(text, b + 1, e - b) AS piece FROM w JOIN d USING (doc_id)
),
s AS (
  SELECT doc_id, CASE WHEN total <= {_SIZE} THEN 0 ELSE b + length(piece) - length(regexp_replace(piece, '^\\s+', '')) END AS start,
         CASE WHEN total <= {_SIZE} THEN total ELSE e - length(piece) + length(regexp_replace(piece, '\\s+$', '')) END AS "end"
  FROM t WHERE total <= {_SIZE} OR regexp_matches(piece, '\\S')
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") - 1 AS n, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM s""",
    "table_spans": f"""WITH RECURSIVE lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, line
  FROM (SELECT l_suppkey AS doc_id, concat_ws(' ', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_partkey, l_linenumber) AS line FROM lineitem)
), placed AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS a, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM lines
), pack AS (
  SELECT doc_id, i, 0 AS n, length(line) + 1 AS held FROM placed WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, p.n + CAST(p.held + length(l.line) > {_SIZE} AS INT), CASE WHEN p.held + length(l.line) > {_SIZE} THEN 0 ELSE p.held END + length(l.line) + 1
  FROM pack p JOIN placed l ON l.doc_id = p.doc_id AND l.i = p.i + 1
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(min(a) AS BIGINT) AS start, CAST(max(a + length(line)) AS BIGINT) AS "end" FROM pack JOIN placed USING (doc_id, i)
GROUP BY doc_id, n""",
}
