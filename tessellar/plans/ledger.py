"""Ledger and history queries, over ``events`` (usage) and ``conversations`` (messages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.operators import ledger as L

MODELS = {"view": "openai/gpt-oss-120b", "click": "vendor/gpt-4o-mini", "purchase": "gpt-4o", "signup": "llama3.1", "error": "unlisted-model"}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    model: Column = F.lit(None).cast("string")
    for kind, name in MODELS.items():
        model = F.when(F.col("event_type") == kind, name).otherwise(model)
    tokens = F.expr("variant_get(try_parse_json(props), '$.k', 'bigint')")
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("tokens", tokens).withColumn("model", model)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    turns = _messages(spark, sf).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count(F.when(F.col("role") == "user", 1)).alias("questions"),
        F.coalesce(F.sum(F.floor((F.length("text") + 3) / 4)), F.lit(0)).cast("long").alias("llm_tokens"),
    )
    calls = _events(spark, sf).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("web_tokens"),
        F.count(F.lit(1)).alias("searches"),
        F.round(F.coalesce(F.sum(F.round("value", 4).cast("decimal(18,4)")), F.lit(0)).cast("double"), 1).alias("web_ms"),
    )
    return turns.crossJoin(calls).withColumn("tokens", F.col("llm_tokens") + F.col("web_tokens"))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    priced = L.with_price(_events(spark, sf), L.prices(spark))
    return priced.withColumn("cost_usd", L.cost_usd(F.col("tokens"), F.col("tokens")))


def usage_report(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("cost_usd").alias("priced_calls"),
        F.count(F.when(F.col("cost_usd").isNull(), 1)).alias("unpriced_calls"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double"), 6).alias("usd"),
        F.sum("tokens").alias("tokens"),
    )


def usage_report_top50(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _priced(spark, sf)
        .orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc())
        .limit(50)
        .select(
            "event_id", "event_type", "model", "tokens", "cost_usd",
            F.when(F.col("cost_usd").isNull(), F.concat(F.lit("no rate on file for "), "model"))
            .when(F.col("price.local"), "runs locally, no metered rate")
            .alias("price_note"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        )
    )


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return L.latency_report(_events(spark, sf), "event_type", "value", [F.col("ts").desc(), F.col("event_id").desc()])


def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    return L.recent_turns(_messages(spark, sf)).select("conv_id", "turn", "role", "place", F.length("text").alias("chars"))


def turn_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return L.pending_questions(_messages(spark, sf))


def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.history_summary(_messages(spark, sf), keep=2)


def context_trim(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return L.context_trim(docs, "source", "doc_id").select("source", "doc_id", "place", "running")


def events_time_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the reference: hourly totals by type."""
    hour = F.window("ts", "1 hour")
    return (
        _events(spark, sf).groupBy(hour.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "tokens")
    )


QUERIES = {
    f.__name__: f
    for f in (
        usage_totals, usage_report, usage_report_top50, latency_percentiles, recent_turns, turn_pairing, history_summary, context_trim,
        events_time_windows,
    )
}

_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items()) + " END"
_EVENTS = f"""ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, {_MODEL} AS model FROM events),
price(name, usd_in, usd_out, local) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {str(c).lower()})" for n, a, b, c in L.PRICES)}),
priced AS (
  SELECT ev.*, coalesce(a.local, b.local) AS local,
         round(tokens * coalesce(a.usd_in, b.usd_in) / 1000000.0::DOUBLE + tokens * coalesce(a.usd_out, b.usd_out) / 1000000.0::DOUBLE, 6) AS cost_usd
  FROM ev LEFT JOIN price a ON a.name = lower(ev.model) LEFT JOIN price b ON b.name = lower(string_split(ev.model, '/')[-1])
)"""
_CLEAN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"

SQL = {
    "usage_totals": f"""WITH {_EVENTS} SELECT m.*, e.*, llm_tokens + web_tokens AS tokens FROM
  (SELECT count(*) AS turns, count(*) FILTER (role = 'user') AS questions, CAST(coalesce(sum((length(text) + 3) // 4), 0) AS BIGINT) AS llm_tokens FROM conversations) m,
  (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS web_tokens, count(*) AS searches, round(CAST(coalesce(sum(CAST(round(value, 4) AS DECIMAL(18,4))), 0) AS DOUBLE), 1) AS web_ms FROM ev) e""",
    "usage_report": f"""WITH {_EVENTS} SELECT model, count(*) AS calls, count(cost_usd) AS priced_calls, count(*) - count(cost_usd) AS unpriced_calls,
  round(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE), 6) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens FROM priced GROUP BY model""",
    "usage_report_top50": f"""WITH {_EVENTS} SELECT event_id, event_type, model, tokens, cost_usd,
  CASE WHEN cost_usd IS NULL THEN 'no rate on file for ' || model WHEN local THEN 'runs locally, no metered rate' END AS price_note,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM priced ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50""",
    "latency_percentiles": """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value > 0) WHERE rn <= 200 GROUP BY event_type""",
    "recent_turns": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
  WHERE role IN ('user', 'assistant') AND regexp_matches(coalesce(text, ''), '\\S'))
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, length(text) AS chars FROM s WHERE back <= 6""",
    "turn_pairing": f"""WITH t AS (
  SELECT conv_id, turn, role, lag(role) OVER w AS p_role, lag(turn) OVER w AS p_turn, lag({_CLEAN}) OVER w AS p_text
  FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN p_role = 'user' THEN p_turn END AS question_turn,
  CASE WHEN p_role = 'user' AND p_text <> '' THEN left(p_text, 200) END AS question FROM t WHERE role = 'assistant'""",
    "history_summary": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, {_CLEAN} AS c FROM conversations),
o AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user asked' WHEN 'assistant' THEN 'assistant answered' ELSE 'conversation noted' END
  || ': ' || left(c, 160) || CASE WHEN length(c) > 160 THEN '...' ELSE '' END AS topic FROM b WHERE back > 2 AND back <= 22 AND c <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
k AS (SELECT conv_id, topic, min(i) AS i FROM r WHERE i <= 3 OR i > n - 3 GROUP BY conv_id, topic)
SELECT conv_id, left(string_agg(topic, ' ' ORDER BY i), 600) AS summary FROM k GROUP BY conv_id""",
    "context_trim": """SELECT source, doc_id, place, running FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place,
  CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= 14000 OR place = 1""",
    "events_time_windows": f"""WITH {_EVENTS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens
FROM ev GROUP BY ALL""",
}
