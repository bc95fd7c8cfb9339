"""Exact deduplication against a persistent digest index (operator 1, native).

The index is a table with one row for each distinct text ever kept, bucketed and
sorted by digest. A batch of documents is reduced to its digests, groups already in
the index fall out in a sort-merge anti-join that shuffles the batch only, and the
remaining groups are appended under the batch's name. A batch that is run again, because
its result was lost, finds its own rows there and gets the same verdicts.

Only DataFrame functions run here. Text is read once; everything after that works on
40-byte rows. A digest that a third of all rows share is summed before its shuffle,
and the join that carries verdicts back to rows joins two plain exchanges, so that
adaptive execution can split its partition.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.workspace import Workspace, delete, list_names

#: Buckets of a new index, and digests (of some 40 bytes) that one bucket is meant to hold.
BUCKETS, BUCKET_ROWS = 32, 1 << 22

INDEX_SCHEMA = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, all other letters untouched."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def buckets_for(rows: int) -> int:
    """Buckets for an index of so many digests."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """The persistent table of digests. ``path`` outlives the session; a new session registers it again.

    A generation is a folder ``g<number>_b<buckets>``; ``compact`` makes the next one and
    then deletes the last. ``buckets`` is for an index that does not exist yet.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        found = []
        for name in list_names(spark, path):
            if m := re.fullmatch(r"g(\d+)_b(\d+)", name):
                # a generation after the first counts when it was written to its end
                if m[1] == "0" or "_SUCCESS" in list_names(spark, f"{path}/{name}"):
                    found.append((int(m[1]), int(m[2])))
        self.generation, self.buckets = max(found, default=(0, buckets))
        self._register()

    @property
    def location(self) -> str:
        return f"{self.path}/g{self.generation}_b{self.buckets}"

    @property
    def table(self) -> str:
        return "tessellar_digests_" + hashlib.md5(self.location.encode()).hexdigest()[:16]

    def _register(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in INDEX_SCHEMA)}) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )

    def read(self) -> DataFrame:
        """One row for each digest; if two batches at once appended one, that of the lesser name."""
        self.spark.catalog.refreshTable(self.table)
        held = self.spark.table(self.table).groupBy("digest").agg(F.min(F.struct("batch", "keep_id")).alias("held"))
        return held.select("digest", "held.keep_id", "held.batch")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index does not have."""
        self.spark.catalog.refreshTable(self.table)
        return groups.join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, mode: str) -> None:
        (
            rows.select(*INDEX_SCHEMA.names)
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode(mode)
            .option("path", self.location)
            .saveAsTable(self.table)
        )

    def append(self, groups: DataFrame) -> None:
        self._write(groups, "append")

    def compact(self, bucket_rows: int = BUCKET_ROWS) -> None:
        """Rewrite the index with one sorted file for each bucket, and as many buckets as its size asks for.

        Every batch appends a file to each bucket; call this after some. Readers of the last
        generation must have ended.
        """
        rows = self.read()
        last_table, last_location = self.table, self.location
        self.generation, self.buckets = self.generation + 1, max(1, -(-rows.count() // bucket_rows))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self._write(rows, "overwrite")
        self.spark.sql(f"DROP TABLE IF EXISTS {last_table}")
        delete(self.spark, last_location)


def exact_dedup(
    docs: DataFrame, index: DigestIndex, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """Deduplicate one batch against the index and append what is new.

    Returns a row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    Of equal texts in a batch, the row with the largest id stays; if another batch brought
    the text already, none does and ``keep_id`` is the row the index holds. ``batch`` names
    the batch (default: a new name): the same rows under the same name get the same verdicts
    again, whether or not the first run came to its end.

    Defined cases: a null text is an empty one; a null id loses against any id; of rows
    equal in id and text one stays; an empty table gives an empty result; columns other
    than the two named are not read, so their names cannot clash.
    """
    batch = batch or ws.id
    staged = ws.write(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            text_digest(F.col(f"`{text_col}`")).alias("digest"),
        ),
        "digests",
    )
    groups = ws.write(
        staged.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(batch).alias("batch"), "group_size"),
        "groups",
    )
    index.append(index.unseen(groups))
    resolved = ws.write(
        groups.select("digest", "group_size", "keep_row").join(index.read().hint("merge"), "digest"),
        "resolved",
    )
    ws.keep_only("digests", "resolved")
    return staged.join(resolved.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of rows equal in id and text, one."""
    key = ["digest", "id", "no_id"]
    named = lambda digest, row_id: (digest.alias("digest"), F.coalesce(row_id, F.lit(0)).alias("id"), row_id.isNull().alias("no_id"))
    keep = exact_dedup(docs, index, ws, id_col, text_col).where("kept").select(*named(F.unhex("text_sha256"), F.col("doc_id")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        *named(text_digest(F.col(f"`{text_col}`")), F.col(f"`{id_col}`").cast("long")),
    )
    # one exchange of whole rows serves both; copies of one text, however many, are spread by their ids
    stays = rows.join(keep.hint("merge"), key, "left_semi")
    return stays.groupBy(key).agg(F.first("row").alias("row")).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as one batch against an index that begins empty."""
    ws = Workspace(spark, "op1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, ws.path("index"), buckets_for(docs.count()))
    return exact_dedup(docs, index, ws)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
