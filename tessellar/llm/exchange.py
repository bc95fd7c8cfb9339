"""Questions that batches of documents ask of the whole corpus, and the answers.

Documents are dealt once into batches of some megabytes of text, kept in a table that is
bucketed by batch: every later pass reads it without a shuffle. A pass turns a batch into
sorted, distinct 64-bit keys with a few numbers for each, cut by key range into one blob
for each range. The blobs of a range meet in one task, which answers each of them, and
the answers go back to their batch.

A key that a third of all documents hold is one entry for each batch, so no key or group
of copies weighs more than the number of batches; ranges of mixed hashes are even. Blobs
hold plain arrays (a few bytes for each key), several times smaller than rows.

A range is what the keys of ``RANGE_BATCHES`` batches come to, so there are that many times
fewer ranges than batches and a task's share stays the same however large the corpus. Blobs
number batches times ranges until a batch has fewer keys than there are ranges, and from
there on at most one for each key: never more than the rows that a plain shuffle would move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.workspace import Workspace

U64 = np.uint64
#: Text of a batch. Larger batches make fewer, longer blobs; for corpora of many terabytes
#: raise it as far as a Python worker's memory allows (about 20 bytes for each of text).
BATCH_BYTES = 12 << 20
MOST_BUCKETS = 50_000
#: Batches whose keys together fill a range.
RANGE_BATCHES = 2
#: Ranges of a small corpus, for work on as many cores.
LEAST_PARTS = 32


class Batches:
    """Documents dealt at random into batches: ``batch, row, doc_id, text``."""

    def __init__(self, docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES):
        self.ws = ws
        texts = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
        )
        size = texts.agg(F.sum(F.length("text") + 64)).first()[0] or 0
        self.n = max(1, -(-size // batch_bytes))
        self.parts = max(min(self.n, LEAST_PARTS), -(-self.n // RANGE_BATCHES))
        row = F.monotonically_increasing_id()
        dealt = texts.select(row.alias("row"), "doc_id", "text").select(F.pmod(F.xxhash64("row"), F.lit(self.n)).alias("batch"), "*")
        self.table = ws.write_bucketed(dealt, "batches", min(self.n, MOST_BUCKETS), "batch")

    def ask(self, question: Callable[[pa.Table], pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
        """Run ``question`` on each batch, with its rows of ``answers`` if there are some; no shuffle of documents."""
        groups = self.table.groupBy("batch")
        if answers is None:
            return groups.applyInArrow(question, schema)
        return groups.cogroup(answers.groupBy("batch")).applyInArrow(question, schema)


def answer(blobs: DataFrame, parts: int, reply: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``reply`` on all blobs of each of ``parts`` ranges; a task for each few ranges, however many there are."""
    return blobs.repartition(parts, "part").groupBy("part").applyInArrow(reply, schema)


def range_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The range (0 to parts - 1) that each key is in; increases with the key."""
    return ((key >> U64(32)) * U64(parts)) >> U64(32)


def cut(key: np.ndarray, parts: int, batch: int, columns: Sequence[tuple[str, Callable[[int, int], bytes]]]) -> pa.Table:
    """A row for each range that has some of the sorted keys: ``part, batch`` and each column's bytes for it."""
    bounds = np.searchsorted(range_of(key, parts), np.arange(parts + 1, dtype=U64))
    used = np.flatnonzero(np.diff(bounds))
    spans = [(int(bounds[p]), int(bounds[p + 1])) for p in used]
    arrays = [pa.array(used, pa.int64()), pa.array(np.full(len(used), batch), pa.int64())]
    arrays += [pa.array([get(a, b) for a, b in spans], pa.binary()) for _, get in columns]
    return pa.Table.from_arrays(arrays, names=["part", "batch", *(name for name, _ in columns)])


def joined(blobs: Sequence[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def grouped(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order (any, among equals) and where each group of equal values begins in it."""
    order = np.argsort(order_by)
    ordered = order_by[order]
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def grouped_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``grouped``, by two numbers of which the first nearly always tells all apart."""
    order, begin = grouped(one)
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
    return order, begin


def found_in(key: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether the sorted table has it, and its place there."""
    if not len(table):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return table[at] == key, at
