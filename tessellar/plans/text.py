"""Text and ingest queries: occurrences, URL keys, injections, intent, offsets, statistics, log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions import text as T
from tessellar.operators import occurrences
from tessellar.plans import sqltext
from tessellar.work import spread

TERM = "and the"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))


def occurrence_count(spark: SparkSession, sf: str) -> DataFrame:
    """The report of one term: the first 40 documents, ten spans each, and the count over all."""
    chunks = _docs(spark, sf).select(
        F.col("source").alias("name"), "source", F.col("doc_id").alias("position"), "text",
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
    )
    found = occurrences.find(chunks, TERM)
    return found.withColumn("matches", F.array_join("matches", ",")).withColumn("total", F.col("total").cast("long"))


def occurrences_by_source(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(f"(?iU){T.phrase_pattern(TERM)}"))
    return _docs(spark, sf).groupBy("source").agg(F.sum(n).alias("matches"), F.count(F.when(n > 0, 1)).alias("documents"))


def url_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", T.url_key(F.col("url")).alias("key"))
    return pages.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count(F.lit(1)).alias("n")).select("key", "f.page_id", "f.url", "n")


def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    said = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    every = _docs(spark, sf).select(F.concat(F.lit("doc "), "doc_id").alias("id"), "text").unionByName(said)
    return every.select("id", T.has_injection(F.col("text")).alias("suspect"))


def intent_kinds(spark: SparkSession, sf: str) -> DataFrame:
    said = spark.read.parquet(f"{sf}/conversations.parquet")
    fixed = "hi|Hello there!|Thanks, that is great.|Hi and who are you?|what can you do please|thanks, what is in chapter 2|and|OK; bye".split("|")
    more = spark.createDataFrame([(-1, i, t) for i, t in enumerate(fixed)], "conv_id long, turn long, text string")
    return said.select("conv_id", "turn", "text").unionByName(more).select("conv_id", "turn", T.intent(F.col("text")).alias("kind"))


def fixed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that are answered without a search, and all as they would be in an empty notebook."""
    return intent_kinds(spark, sf).withColumn("reply", T.reply_for(F.col("kind")))


def block_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each line would begin and end if lines were blocks joined by an empty line."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 2).over(before), F.lit(0))
    return lines.withColumn("start", start).select("doc_id", "pos", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("line")).cast("long").alias("end"))


def chunk_stats_by_source(spark: SparkSession, sf: str) -> DataFrame:
    chars = F.length("text")
    return _docs(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(chars).alias("chars"), F.max(chars).alias("max_chars"),
        F.round(F.avg(chars)).cast("long").alias("avg_rounded"), F.floor(F.sum(chars) / F.count(F.lit(1))).alias("avg_truncated"),
        F.max(T.token_estimate(F.col("text"))).alias("token_max"), F.count(F.when(T.numeric_heavy(F.col("text")), 1)).alias("numeric"),
    )


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Per language, the first holder of each content hash and how many there are."""
    hashed = _docs(spark, sf).select("lang", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return hashed.groupBy("lang", "digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(T.cleaned(F.col("text")).cast("binary"), 256).alias("digest"))


def utf16_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.utf16_length(F.col("text")).alias("units"), F.length("text").alias("points"))


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events rendered as log lines, every third with a continuation, grouped again by running sum of stamped lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    head = F.concat(stamp, F.lit(" "), F.upper("event_type"), F.lit(" "), "props")
    lines = spark.read.parquet(f"{sf}/events.parquet").select(
        "user_id", "event_id", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(head, F.lit("  at handler"))).otherwise(F.array(head))).alias("line")
    )
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id", F.col("line").startswith(" ")))
    flag = F.col("line").rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2})").cast("int")
    run = F.sum("flag").over(W.partitionBy("user_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    islands = lines.withColumn("place", place).withColumn("flag", flag).withColumn("event", run)
    return islands.groupBy("user_id", "event").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max(F.when(F.col("flag") == 1, F.substring("line", 1, 19))).alias("heading")
    )


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of the assistant, each reply cited by its turn and, wrongly, by one beyond ten."""
    said = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant'")
    marked = F.concat(F.col("text"), F.lit(" ["), F.col("turn") + 1, F.lit("] 【"), F.lit("１２"), F.lit("】 ["), F.col("turn") + 1, F.lit("]"))
    found = said.select("conv_id", "turn", T.citations(marked).alias("cited"))
    valid = F.array_sort(F.array_distinct(F.filter("cited", lambda n: (n >= 1) & (n <= 10))))
    wrong = F.array_sort(F.array_distinct(F.filter("cited", lambda n: (n < 1) | (n > 10))))
    return found.select("conv_id", "turn", F.array_join("cited", ",").alias("cited"), F.array_join(valid, ",").alias("valid"), F.array_join(wrong, ",").alias("invalid"))


QUERIES = {
    f.__name__: f
    for f in (
        occurrence_count, occurrences_by_source, url_dedupe, injection_scan, intent_kinds, fixed_replies, block_offsets, chunk_stats_by_source, exact_duplicates,
        clean_text, utf16_lengths, log_events, citation_check,
    )
}

_HIT = r"(?i)\band[\s\-\x{2010}-\x{2015}]+the\b"
_INJECTION = "(?i)" + T.INJECTION.replace("'", "''")
_LIST = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_KIND = (
    f"CASE WHEN {{p}} IN {_LIST(T.GREETINGS)} THEN 'greeting' WHEN {{p}} IN {_LIST(T.SMALL_TALK)} THEN 'small_talk' "
    f"WHEN {{p}} IN {_LIST(T.ASSISTANT)} OR regexp_matches({{p}}, '{T.ASSISTANT_FORM}') THEN 'assistant' END"
)
_PLAIN = "trim(regexp_replace(lower({t}), '[^a-z0-9'']+', ' ', 'g'))"
# RE2 has the ASCII word edge only, so words next to letters outside ASCII are put apart first
_EDGED = "regexp_replace(text, '([^\\x00-\\x7F])', 'x\\1x', 'g')"
_UTF16 = "(length({t}) + length(regexp_replace({t}, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))"

SQL = {
    "occurrence_count": rf"""WITH d AS (SELECT source, doc_id, text, regexp_extract_all({_EDGED}, '{_HIT}') AS m,
    regexp_split_to_array({_EDGED}, '{_HIT}') AS p FROM documents),
h AS (SELECT source, doc_id, text, len(m) AS n, list_transform(range(1, len(m) + 1), lambda i:
    CAST(list_sum(list_transform(p[1:i], lambda x: length(regexp_replace(x, 'x([^\x00-\x7F])x', '\1', 'g')))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)) AS begins,
    list_transform(m, lambda x: length(x)) AS own FROM d WHERE len(m) > 0),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_chunks FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS place FROM h)
SELECT place, source AS name, source, doc_id AS position, n AS count,
  array_to_string(list_transform(range(1, least(n, 10) + 1), lambda i: {_UTF16.format(t="left(text, begins[i])")} || ':' || {_UTF16.format(t="left(text, begins[i] + own[i])")}), ',') AS matches,
  n > 10 AS more, total, n_chunks > 40 AS truncated FROM o, t WHERE place <= 40""",
    "occurrences_by_source": f"""SELECT source, CAST(sum(len(regexp_extract_all({_EDGED}, '{_HIT}'))) AS BIGINT) AS matches,
  count(*) FILTER (len(regexp_extract_all({_EDGED}, '{_HIT}')) > 0) AS documents FROM documents GROUP BY source""",
    "url_dedupe": r"""WITH k AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
  || CASE WHEN rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE url_decode(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) END AS key FROM pages)
SELECT key, min(page_id) AS page_id, arg_min(url, page_id) AS url, count(*) AS n FROM k GROUP BY key""",
    "injection_scan": f"""SELECT 'doc ' || doc_id AS id, regexp_matches(coalesce(text, ''), '{_INJECTION}') AS suspect FROM documents
UNION ALL SELECT conv_id || '/' || turn, regexp_matches(coalesce(text, ''), '{_INJECTION}') FROM conversations""",
    "intent_kinds": f"""WITH said AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES
  (-1, 0, 'hi'), (-1, 1, 'Hello there!'), (-1, 2, 'Thanks, that is great.'), (-1, 3, 'Hi and who are you?'), (-1, 4, 'what can you do please'),
  (-1, 5, 'thanks, what is in chapter 2'), (-1, 6, 'and'), (-1, 7, 'OK; bye'))),
p AS (SELECT conv_id, turn, {_PLAIN.format(t="text")} AS whole,
  list_filter(list_transform(regexp_split_to_array(lower(text), '[,;.!?]+|\\b(?:and|then|plus)\\b'), lambda x: {_PLAIN.format(t="x")}), lambda x: x <> '') AS parts FROM said),
k AS (SELECT conv_id, turn, {_KIND.format(p="whole")} AS whole, list_transform(parts, lambda x: coalesce({_KIND.format(p="x")}, 'question')) AS kinds FROM p)
SELECT conv_id, turn, coalesce(whole, CASE WHEN len(kinds) < 2 OR list_contains(kinds, 'question') THEN 'question' WHEN list_contains(kinds, 'assistant') THEN 'assistant'
  WHEN list_contains(kinds, 'greeting') THEN 'greeting' ELSE 'small_talk' END) AS kind FROM k""",
    "block_offsets": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, line, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, pos, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS end FROM s""",
    "chunk_stats_by_source": f"""SELECT source, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS max_chars, CAST(round(avg(length(text))) AS BIGINT) AS avg_rounded,
  CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_truncated, max(greatest(1, (length(text) + 3) // 4)) AS token_max, count(*) FILTER ({sqltext.numeric_heavy("text")}) AS numeric
FROM (SELECT source, coalesce(text, '') AS text FROM documents) GROUP BY source""",
    "exact_duplicates": "SELECT lang, sha256(coalesce(text, '')) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "clean_text": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '^\x{FEFF}+', ''), chr(160), ' '), '[ \t]+', ' ', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
    "utf16_lengths": f"SELECT doc_id, {_UTF16.format(t="coalesce(text, '')")} AS units, length(coalesce(text, '')) AS points FROM documents",
    "log_events": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS event, 1 + CAST(event_id % 3 = 0 AS INT) AS n_lines, strftime(ts, '%Y-%m-%d %H:%M:%S') AS heading FROM events""",
    "citation_check": r"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] 【１２】 [' || (turn + 1) || ']', '[\[［【]([0-9０-９]{1,3})[\]］】]', 1),
  lambda n: CAST(translate(n, '０１２３４５６７８９', '0123456789') AS INT)) AS cited FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, array_to_string(cited, ',') AS cited, array_to_string(list_sort(list_distinct(list_filter(cited, lambda n: n BETWEEN 1 AND 10))), ',') AS valid,
  array_to_string(list_sort(list_distinct(list_filter(cited, lambda n: n NOT BETWEEN 1 AND 10))), ',') AS invalid FROM c""",
}
_REPLY = " ".join(f"WHEN '{k}' THEN '{r.replace(chr(39), chr(39) * 2)}'" for k, r in T.REPLIES.items())
SQL["fixed_replies"] = f"SELECT conv_id, turn, kind, CASE kind {_REPLY} ELSE '{T.EMPTY_REPLY}' END AS reply FROM ({SQL['intent_kinds']})"
