"""Line deduplication with a suffix array by distributed prefix doubling (operator 7).

Lines become numbers (a 64-bit hash of the line, so that order is that of the hashes),
and each document a sequence of them. Prefix doubling sorts the suffixes: a place's rank
after k lines and the rank of the place k lines on give its rank after 2k lines. Only the
distinct pairs of ranks are sorted, by range over the cluster, and numbered in that
order; a place whose prefix occurs once is settled and drops out, so each round works on
repeated prefixes only, and rounds go on until every suffix is settled.

Places of equal rank after k lines are an interval of the suffix array with a longest
common prefix of k lines or more: its first place, in order of documents, is the one that
stays. A repeated run counts if it has enough lines, or enough words in fewer lines; the
union of what counts are the maximal runs. How long repeats get is told to the round.

A rank that a third of all places share is counted before its shuffle, and joins are
between two plain exchanges, which adaptive execution can split. Texts are not shuffled
but for documents that lose lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.bitmap import split_by
from tessellar.llm.workspace import Workspace

#: Lines of the shortest run that counts as repeated, and words of one of fewer lines.
LEAST_LINES, LEAST_WORDS = 3, 13


def _numbered(pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The distinct pairs (x, y) with ``rank``: their place in the order of pairs, over all partitions."""
    ordered = pairs.repartitionByRange("x", "y").sortWithinPartitions("x", "y")
    # the partition number is in the high bits and partitions are ranges, so this follows the order
    return ws.write(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def _double(places: DataFrame, step: int, ws: Workspace, name: str) -> DataFrame:
    """Ranks after ``step`` more lines, of the places whose longer prefix is repeated.

    ``places``: ``row, line, rank``. The prefix at a place is cut short by the end of its
    document, so a place without another ``step`` lines on drops out.
    """
    on = places.select("row", (F.col("line") - step).alias("line"), F.col("rank").alias("y"))
    paired = ws.write(places.join(on.hint("merge"), ["row", "line"]).select("row", "line", F.col("rank").alias("x"), "y"), f"{name}_pairs")
    repeated = paired.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    ranks = _numbered(repeated, ws, f"{name}_ranks")
    out = ws.write(paired.join(ranks.hint("merge"), ["x", "y"]).select("row", "line", "rank"), name)
    ws.drop(f"{name}_pairs", f"{name}_ranks")
    return out


def _rounds(least: int, every: bool) -> list[int]:
    """Lengths of prefixes up to ``least`` lines: all of them, or what doubling passes through."""
    lengths = [1]
    while lengths[-1] < least:
        lengths.append(min(lengths[-1] + (1 if every else lengths[-1]), least))
    return lengths


def repeated_runs(lines: DataFrame, least: int, least_words: int | None, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Where repeated runs that count begin, and how long repeats get.

    ``lines``: ``row, line, number, words``. The first table has ``row, line, size, rank``:
    places of equal size and rank begin equal runs of that many lines, which occur more than
    once and have ``least`` lines, or ``least_words`` words in fewer. The second has ``row,
    depth``: the longest prefix (in lines, as doubling goes) that the document has in common
    with another place, for documents that have one.
    """
    numbers = ws.write(lines.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number"), "numbers")
    places = ws.write(lines.join(numbers.hint("merge"), "number").select("row", "line", F.col("number").alias("rank"), "words"), "places1")
    words, places, name, size = places.select("row", "line", "words"), places.drop("words"), "places1", 1
    rounds = _rounds(least, least_words is not None)
    runs, depths, over = [], [], ["numbers"]
    while not places.isEmpty():
        if size == least:
            runs.append(places.withColumn("size", F.lit(size)))
        elif size < least and least_words is not None:
            # equal runs have equal words, so this leaves an interval whole
            own = words.select("row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("line") - (size - 1)), "line")).alias("line"), "words")
            enough = own.groupBy("row", "line").agg(F.sum("words").alias("words")).where(F.col("words") >= least_words).select("row", "line")
            runs.append(ws.write(places.join(enough.hint("merge"), ["row", "line"]).withColumn("size", F.lit(size)), f"worded{size}"))
        depths.append(ws.write(places.select("row").distinct().withColumn("depth", F.lit(size)), f"depth{size}"))
        if size not in (1, least):
            over.append(name)
        longer = rounds[rounds.index(size) + 1] if size < least else 2 * size
        places, name, size = _double(places, longer - size, ws, f"places{longer}"), f"places{longer}", longer
    ws.drop(*over, name)
    found = ws.spark.createDataFrame([], "row long, line int, rank long, size int")
    depth = ws.spark.createDataFrame([], "row long, depth int")
    for some in runs:
        found = found.unionByName(some)
    for some in depths:
        depth = depth.unionByName(some)
    return found, depth.groupBy("row").agg(F.max("depth").alias("depth"))


def line_dedup(
    docs: DataFrame,
    ws: Workspace,
    least: int = LEAST_LINES,
    least_words: int | None = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Delete later copies of repeated runs of ``least`` lines, or of fewer with ``least_words`` words.

    Lines are what ``\\n`` separates, words what white space separates. A line is deleted
    if it lies in such a run that also begins earlier: in a document with a smaller id, or
    before it in the same document. Runs are judged on the input, so what is deleted are
    maximal runs.

    Returns for each input row ``doc_id, n_lines, n_removed, n_runs`` (deleted stretches),
    ``longest_run`` (lines of the longest one), ``repeat_depth`` (the longest of 1, 2, 3, 6,
    12, ... lines, for ``least`` 3, that a run of the document has and that is repeated),
    ``kept_text`` and ``kept_sha256`` (of the kept lines joined by ``\\n``).

    Defined cases: a null text has no lines, an empty one has one; a document without such
    a run keeps all; rows without id come after all others, and rows of one id follow one
    another in the order they are read; an empty table gives an empty result; other columns
    are not read.
    """
    text = F.col(f"`{text_col}`")
    split = F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))
    texts = ws.write(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), split.alias("lines")), "texts"
    )
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    lines = texts.select("row", F.posexplode("lines").alias("line", "text")).select("row", "line", F.xxhash64("text").alias("number"), words)
    runs, depth = repeated_runs(lines, least, least_words, ws)
    ids = texts.select("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("doc"))
    placed = ws.write(runs.join(ids.hint("merge"), "row"), "placed")
    first = ws.write(placed.groupBy("size", "rank").agg(F.min(F.struct("doc", "row", "line")).alias("first")), "intervals")
    later = (
        placed.join(first.hint("merge"), ["size", "rank"])
        .where(F.struct("doc", "row", "line") > F.col("first"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("line", "size"))).alias("starts"))
    )
    # lines of a document that a later copy covers: at most its own lines
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["line"], s["line"] + s["size"] - 1)))))
    told = ws.write(later.select("row", gone.alias("gone")).join(depth.hint("merge"), "row", "full"), "told")
    ws.keep_only("texts", "told")
    alone, others = split_by(texts, told, "row")
    none = F.array().cast("array<int>")
    joined = others.join(told.hint("merge"), "row", "left").select("doc_id", "lines", F.coalesce("gone", none).alias("gone"), F.coalesce("depth", F.lit(0)).alias("depth"))
    joined = joined.unionByName(alone.select("doc_id", "lines", none.alias("gone"), F.lit(0).alias("depth")))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), F.col("gone")),
            lambda i: F.element_at("lines", i + 1),
        )
    )
    kept_text = F.array_join(kept, "\n")
    # a stretch begins where the line before is kept and ends where the line after is
    begins = F.array_except("gone", F.transform("gone", lambda g: g + 1))
    ends = F.array_except("gone", F.transform("gone", lambda g: g - 1))
    sizes = F.zip_with(begins, ends, lambda a, b: b - a + 1)
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(begins).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest_run"),
        F.col("depth").cast("long").alias("repeat_depth"),
        kept_text.alias("kept_text"),
        F.sha2(kept_text.cast("binary"), 256).alias("kept_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, runs of three lines or of 13 words in one or two."""
    ws = Workspace(spark, "op7")
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ws).drop("kept_text")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l
  FROM documents
), lines AS (
  SELECT r, doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS p FROM d WHERE len(l) > 0
), runs AS (
  SELECT r, p, h, l[p : p + h - 1] AS run
  FROM (SELECT r, l, h, unnest(range(1, len(l) - h + 2)) AS p FROM d, (SELECT unnest([1, 2, 3]) AS h) WHERE len(l) >= h)
), counted AS (
  SELECT r, p, h FROM runs WHERE h = 3 OR len(regexp_extract_all(array_to_string(run, chr(10)), '[^\x20\x09-\x0D]+')) >= 13
), later AS (
  SELECT r, p, h FROM (SELECT r, p, h, row_number() OVER (PARTITION BY h, run ORDER BY r, p) AS k FROM counted JOIN runs USING (r, p, h)) WHERE k > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(p, p + h)) AS p FROM later
), kept AS (
  SELECT r, string_agg(t, chr(10) ORDER BY p) AS t FROM lines ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (
  SELECT r, sum(n) AS n, count(*) AS runs, max(n) AS longest
  FROM (SELECT r, count(*) AS n FROM (SELECT r, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM gone) GROUP BY r, island) GROUP BY r
), deep AS (
  SELECT r, max(h) AS depth FROM (
    SELECT r, h, count(*) OVER (PARTITION BY h, sha) AS n FROM (
      SELECT r, h, sha256(array_to_string(list_transform(l[p : p + h - 1], lambda x: sha256(x)), ',')) AS sha
      FROM (SELECT r, l, h, unnest(range(1, len(l) - h + 2)) AS p FROM d, (SELECT unnest([1, 2] || list_transform(range(0, 16), lambda k: 3 * (1 << k))) AS h) WHERE len(l) >= h))
  ) WHERE n > 1 GROUP BY r
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_runs,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, CAST(coalesce(depth, 0) AS BIGINT) AS repeat_depth, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r) LEFT JOIN deep USING (r)
"""
