"""Notebook tables on Parquet and the commands that change them.

Every table is partitioned by session and written whole partitions at a time (read,
transform, overwrite), so a reader sees a partition before or after a command. Columns
that are NULL mean "not measured".
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.work import delete, exists

SCHEMAS = {
    "sessions": "id string, name string, is_default boolean, created_at timestamp, updated_at timestamp, session_id string",
    "sources": (
        "id string, name string, kind string, url string, pages int, chunk_count int, numeric_count int, content_hash string, token_max int, "
        "fit_splits int, size_splits int, file_bytes long, parsed_text string, page_offsets array<int>, created_at timestamp, session_id string"
    ),
    "chunks": (
        "chunk_id long, source_id string, position int, page int, heading string, text string, numeric_heavy boolean, char_start int, "
        "char_end int, embedding array<float>, session_id string"
    ),
    "messages": "id long, role string, content string, citations string, evidence string, created_at timestamp, session_id string",
    "usage_events": (
        "id long, kind string, model string, prompt_tokens int, completion_tokens int, latency_ms double, created_at timestamp, session_id string"
    ),
}
UNTITLED = "Untitled session"


class Store:
    """Tables under ``root``; commands take and keep DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, table: str) -> bool:
        return exists(self.spark, f"{self.root}/{table}")

    def read(self, table: str, session: str | None = None) -> DataFrame:
        """A table, or the partition of one session; columns a partition was written without are NULL."""
        if not self._exists(table):
            rows = self.spark.createDataFrame([], SCHEMAS[table])
        else:
            rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}")
        return rows if session is None else rows.where(F.col("session_id") == session)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.select(*[f.name for f in self.read(table).schema]).write.partitionBy("session_id").mode("append").parquet(f"{self.root}/{table}")

    def _replace(self, table: str, session: str, rows: DataFrame) -> None:
        """Put ``rows`` in place of a session's partition. They may read it: they are staged first."""
        staged = self._staged()
        columns = [f.name for f in self.read(table).schema]
        rows.select(*columns).write.parquet(staged)
        kept = self.spark.read.schema(SCHEMAS[table]).parquet(staged)
        if kept.isEmpty():
            delete(self.spark, f"{self.root}/{table}/session_id={session}")
        else:
            writer = kept.write.option("partitionOverwriteMode", "dynamic").partitionBy("session_id")
            writer.mode("overwrite").parquet(f"{self.root}/{table}")
        delete(self.spark, staged)

    def _staged(self) -> str:
        """A new folder for what one command writes before the tables change."""
        return f"{self.root}/_staged/{uuid.uuid4().hex}"

    def _numbered(self, chunks: DataFrame, staged: str) -> DataFrame:
        """``chunks`` with ids after the largest, in order of source and position.

        Only counts of sources are put in order, by ranges, and the sums of the ranges in
        one task; a chunk's place is found among those of its own source. The counts are
        in the folder ``staged``, which the caller deletes.
        """
        last = self.read("chunks").agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
        counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("source_id")
        counts.withColumn("range", F.spark_partition_id()).write.parquet(staged)
        counts = self.spark.read.parquet(staged)
        ahead = W.rowsBetween(W.unboundedPreceding, -1)
        sums = counts.groupBy("range").agg(F.sum("n").alias("n"))
        starts = sums.select("range", F.coalesce(F.sum("n").over(ahead.orderBy("range")), F.lit(0)).alias("start"))
        inside = F.coalesce(F.sum("n").over(ahead.partitionBy("range").orderBy("source_id")), F.lit(0))
        # as many rows as shuffle partitions
        first = counts.join(F.broadcast(starts), "range").select("source_id", (F.col("start") + inside + F.lit(last)).alias("first"))
        place = F.row_number().over(W.partitionBy("source_id").orderBy("position"))
        return chunks.join(first, "source_id").withColumn("chunk_id", F.col("first") + place).drop("first")

    # sessions

    def create_session(self, session: str, name: str, is_default: bool = False) -> None:
        name = " ".join((name or "").split()) or UNTITLED
        now = F.current_timestamp()
        row = self.spark.range(1).select(
            F.lit(session).alias("id"), F.lit(name).alias("name"), F.lit(is_default).alias("is_default"), now.alias("created_at"),
            now.alias("updated_at"), F.lit(session).alias("session_id"),
        )
        self.append("sessions", row)

    def ensure_default_session(self, session: str = "default") -> str:
        """The default session, made if there is none; there is never more than one."""
        held = self.read("sessions").where("is_default").select("id").first()
        if held:
            return held.id
        self.create_session(session, UNTITLED, is_default=True)
        return session

    def rename_session(self, session: str, name: str) -> None:
        name = " ".join((name or "").split()) or UNTITLED
        rows = self.read("sessions", session).withColumn("name", F.lit(name)).withColumn("updated_at", F.current_timestamp())
        self._replace("sessions", session, rows)

    def touch_session(self, session: str) -> None:
        self._replace("sessions", session, self.read("sessions", session).withColumn("updated_at", F.current_timestamp()))

    def list_sessions(self) -> DataFrame:
        counts = self.read("sources").groupBy("session_id").agg(F.count(F.lit(1)).alias("sources"))
        return self.read("sessions").join(counts, "session_id", "left").orderBy(F.col("updated_at").desc(), "id")

    def delete_session(self, session: str) -> None:
        """With its sources, chunks and messages; the ledger keeps its rows without a session."""
        for table in ("chunks", "sources", "messages", "sessions"):
            self._replace(table, session, self.read(table, session).limit(0))
        orphans = self.read("usage_events", session).withColumn("session_id", F.lit(None).cast("string"))
        if not orphans.isEmpty():
            self.append("usage_events", orphans)
            self._replace("usage_events", session, self.read("usage_events", session).limit(0))

    # sources

    def find_duplicates(self, incoming: DataFrame) -> DataFrame:
        """``content_hash, id`` of the earliest source with an incoming row's hash in its session."""
        w = W.partitionBy("session_id", "content_hash").orderBy("created_at", "id")
        first = self.read("sources").where("content_hash <> ''").withColumn("rn", F.row_number().over(w)).where("rn = 1")
        keys = incoming.select("session_id", "content_hash").distinct()
        return first.join(keys, ["session_id", "content_hash"], "left_semi").select("session_id", "content_hash", "id")

    def add_sources(self, sources: DataFrame, chunks: DataFrame) -> None:
        """Add sources whose content the session does not have, with their chunks and counts.

        Equal contents among the new ones are one: the first id. Chunk ids go on from the
        largest, in order of source and position.
        """
        known = self.read("sources").where("content_hash <> ''").select("session_id", "content_hash")
        w = W.partitionBy("session_id", F.when(F.col("content_hash") == "", F.col("id")).otherwise(F.col("content_hash"))).orderBy("id")
        fresh = sources.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").join(known, ["session_id", "content_hash"], "left_anti")
        own = chunks.join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        counts = own.groupBy("source_id").agg(
            F.count(F.lit(1)).cast("int").alias("chunk_count"), F.count(F.when(F.col("numeric_heavy"), 1)).cast("int").alias("numeric_count")
        )
        counted = fresh.drop("chunk_count", "numeric_count").join(counts, fresh["id"] == counts["source_id"], "left").drop("source_id")
        counted = counted.fillna(0, ["chunk_count", "numeric_count"])
        staged = self._staged()
        self.append("chunks", self._numbered(own, staged))
        self.append("sources", counted)
        delete(self.spark, staged)

    def reindex(self, session: str, source: str, chunks: DataFrame) -> None:
        """New chunks for a source that keeps its id and time of creation."""
        staged = self._staged()
        fresh = self._numbered(chunks, staged)
        others = self.read("chunks", session).where(F.col("source_id") != source)
        self._replace("chunks", session, others.unionByName(fresh.select(*others.columns)))
        delete(self.spark, staged)
        counts = self.read("chunks", session).where(F.col("source_id") == source).agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.count(F.when(F.col("numeric_heavy"), 1)).cast("int").alias("m")
        )
        mine = F.col("id") == source
        rows = self.read("sources", session).crossJoin(counts)
        rows = rows.withColumn("chunk_count", F.when(mine, F.col("n")).otherwise(F.col("chunk_count")))
        self._replace("sources", session, rows.withColumn("numeric_count", F.when(mine, F.col("m")).otherwise(F.col("numeric_count"))))

    def remove_source(self, session: str, source: str) -> None:
        self._replace("chunks", session, self.read("chunks", session).where(F.col("source_id") != source))
        self._replace("sources", session, self.read("sources", session).where(F.col("id") != source))

    def clear(self, session: str) -> None:
        for table in ("chunks", "sources"):
            self._replace(table, session, self.read(table, session).limit(0))

    def sources(self, session: str) -> DataFrame:
        """The session's sources, by creation, with the mean (rounded) and longest length of their chunks."""
        sizes = self.read("chunks", session).groupBy(F.col("source_id").alias("id")).agg(
            F.round(F.avg(F.length("text"))).cast("int").alias("avg_chars"), F.max(F.length("text")).alias("max_chars")
        )
        return self.read("sources", session).join(sizes, "id", "left").orderBy("created_at", "id")

    def stats(self, session: str) -> DataFrame:
        """One row of sums; NULL stays out of them and a notebook without sources counts 0."""
        listed = self.sources(session)
        n = F.sum("chunk_count")
        return listed.agg(
            F.count(F.lit(1)).alias("sources"),
            F.coalesce(n, F.lit(0)).alias("chunks"),
            F.coalesce(F.sum("numeric_count"), F.lit(0)).alias("numeric"),
            F.coalesce(F.round(100 * F.sum("numeric_count") / n, 1), F.lit(0.0)).alias("numeric_pct"),
            F.coalesce(F.floor(F.sum(F.col("avg_chars") * F.col("chunk_count")) / n), F.lit(0)).alias("avg_chars"),
            F.coalesce(F.max("max_chars"), F.lit(0)).alias("max_chars"),
            F.sum("size_splits").alias("size_splits"),
            F.count(F.when(F.col("token_max") == 0, 1)).alias("unmeasured"),
        )

    # messages and ledger

    def add_message(self, session: str, role: str, content: str, citations: object = None, evidence: object = None) -> None:
        """One message; citations and evidence are JSON, or values to be written as JSON."""
        if role not in ("user", "assistant"):
            raise ValueError(f"role: {role}")
        last = self.read("messages").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        text = lambda v: F.lit(v).cast("string")
        as_json = lambda v: text(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False))
        self.append(
            "messages",
            self.spark.range(1).select(
                F.lit(last + 1).cast("long").alias("id"), text(role).alias("role"), text(content).alias("content"),
                as_json(citations).alias("citations"), as_json(evidence).alias("evidence"), F.current_timestamp().alias("created_at"),
                text(session).alias("session_id"),
            ),
        )

    def add_messages(self, rows: DataFrame) -> None:
        """Messages with their ids; citations and evidence of any nested type are written as JSON."""
        nested = [c for c in ("citations", "evidence") if not isinstance(rows.schema[c].dataType, T.StringType)]
        self.append("messages", rows.withColumns({c: F.to_json(c) for c in nested}))

    def clear_messages(self, session: str) -> None:
        self._replace("messages", session, self.read("messages", session).limit(0))

    def record_usage(self, events: DataFrame) -> None:
        self.append("usage_events", events)

    def problems(self) -> DataFrame:
        """Rows that break a rule of the tables: ``rule, key``. Empty when all is well."""
        chunks, sources, sessions = self.read("chunks"), self.read("sources"), self.read("sessions")
        found = [
            ("two chunks at one position", chunks.groupBy("source_id", "position").count().where("count > 1").select(F.col("source_id").alias("key"))),
            ("chunk without source", chunks.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(F.col("source_id").alias("key"))),
            ("source without session", sources.join(sessions.select("session_id"), "session_id", "left_anti").select(F.col("id").alias("key"))),
            ("two default sessions", sessions.where("is_default").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("sessions").alias("key"))),
            ("role", self.read("messages").where(~F.col("role").isin("user", "assistant")).select(F.col("id").cast("string").alias("key"))),
        ]
        out = None
        for rule, rows in found:
            rows = rows.select(F.lit(rule).alias("rule"), "key")
            out = rows if out is None else out.unionByName(rows)
        return out
