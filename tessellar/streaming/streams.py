"""Structured Streaming forms of ingestion, latency and the ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessellar.config import DEFAULTS

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_at_once: int = 2) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def new_files(files: DataFrame) -> DataFrame:
    """Files whose content a session does not have yet.

    The state is a row for each (session, hash): exact, and as large as what was taken in.
    """
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.dropDuplicates(["session_id", "content_hash"])


def ledger_totals(calls: DataFrame) -> DataFrame:
    """Running totals by kind: complete mode, one row of state for each kind."""
    tokens = F.expr("variant_get(try_parse_json(props), '$.k', 'bigint')")
    return calls.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"))


def hourly(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly totals, final when the watermark passes (beyond the reference)."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def latency(calls: DataFrame, window: int = DEFAULTS.latency_window) -> DataFrame:
    """p50, p95, maximum and count of the last ``window`` positive samples of each kind, after each batch.

    The state of a kind is its last samples, so it is bounded.
    """

    def rank(values: list[float], share: float) -> float:
        ordered = sorted(values)
        # nearest rank: the least value that at least this share is no greater than
        return ordered[max(0, -(-int(share * 100) * len(ordered) // 100) - 1)]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            held += list(zip(batch["ts"].astype("int64"), batch["event_id"], batch["value"], strict=True))
        held = sorted(held)[-window:]
        state.update(tuple([x[k] for x in held] for k in range(3)))
        values = [v for _, _, v in held]
        yield pd.DataFrame({"event_type": [key[0]], "p50": [rank(values, 0.5)], "p95": [rank(values, 0.95)], "max": [max(values)], "n": [len(values)]})

    return (
        calls.where(F.col("value") > 0)
        .select("event_type", "ts", "event_id", "value")
        .groupBy("event_type")
        .applyInPandasWithState(
            update,
            "event_type string, p50 double, p95 double, max double, n long",
            "ts array<long>, event_id array<long>, value array<double>",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, run to the end into a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    running = query.trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)
