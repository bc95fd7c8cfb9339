"""Benchmark decontamination by winnowing (operator 3).

A window is 13 consecutive words of a benchmark item (all words of a shorter item).
Both sides keep one fingerprint for each window: the least hash of its 9-word runs.
Equal windows have equal fingerprints, so joining the fingerprints of documents with
those of the benchmark finds every shared span of 13 words or more; each hit is then
extended to its 13 words and compared byte by byte, so hashes never decide a result.

The benchmark is dealt into blocks of a bounded size; each block is broadcast, as sorted
arrays of some 45 bytes a window beside its text, for one pass over the documents, and a pass carries what earlier blocks found. A usual benchmark
is one block. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.exchange import found_in
from tessellar.llm.wordstream import ALNUM, LOWER_AZ, Words, binaries, cover, run_hashes, runs_inside, slices
from tessellar.llm.workspace import Workspace

WINDOW, GRAM = 13, 9
#: Bytes of benchmark text that one pass broadcasts as some eight times as many of index.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are worked on at once.
STEP_BYTES = 4 << 20

_TO_WORDS = bytes(LOWER_AZ[b] if ALNUM[LOWER_AZ[b]] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_TO_WORDS).split()


class _Windows:
    """Distinct windows of one length: hashes, where one of each is in the text, whose they are, fingerprints.

    Some 45 bytes a window: two hashes, a place, the bounds and members of its list of items, a
    fingerprint, and two bytes of bits that tell most fingerprints apart without a search.
    """

    def __init__(self, hashed: np.ndarray, start: np.ndarray, place: np.ndarray, item: np.ndarray, length: int, gram: int):
        self.length, self.gram = length, min(gram, length)
        one, two = (run_hashes(hashed, length, seed)[start] for seed in (0, 1))
        order = np.lexsort((item, two, one))
        one, two, item = one[order], two[order], item[order].astype(np.int32)
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        begin = np.flatnonzero(new)
        self.one, self.two, self.place = one[begin], two[begin], place[order][begin]
        mine = new.copy()
        mine[1:] |= item[1:] != item[:-1]
        self.item = item[mine]
        self.bounds = np.append(np.cumsum(mine)[begin] - 1, len(self.item)).astype(np.int32)
        self.prints = np.unique(self.least(hashed, start))
        self.mask = np.uint64((1 << max(16, (16 * len(self.prints)).bit_length())) - 1)
        slot = self.prints & self.mask
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        np.bitwise_or.at(self.bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))

    def least(self, hashed: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The fingerprint of each window: the least hash of its runs of ``gram`` words."""
        run = run_hashes(hashed, self.gram)
        least = run[start]
        for j in range(1, self.length - self.gram + 1):
            np.minimum(least, run[start + j], out=least)
        return least

    def probable(self, hashed: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of windows of documents, those whose fingerprint and first hash some window here has."""
        least = self.least(hashed, start)
        slot = least & self.mask
        start = start[(self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        # one hash of the whole window in place of the fingerprint's list of windows
        return start[found_in(run_hashes(hashed, self.length)[start], self.one)[0]]


class Fingerprints:
    """One block of the benchmark: its windows, exactly, and their fingerprints, in sorted arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, gram: int = GRAM):
        texts = [b" ".join(words_of(text)) for _, text in items]
        words = Words(texts)
        hashed, first, size = words.hashes(), words.first, np.diff(words.first)
        names, owner = np.unique(np.array([item for item, _ in items], object), return_inverse=True) if items else ([], np.zeros(0, np.int64))
        self.names, self.text = list(names), words.buffer
        of_word = owner[words.text_of_word()] if items else owner
        self.lengths: list[_Windows] = []
        for n in sorted({min(int(k), window) for k in size if k}):
            start = np.flatnonzero(runs_inside(first, n)) if n == window else first[:-1][size == n]
            self.lengths.append(_Windows(hashed, start, words.start[start], of_word[start], n, gram))

    def items_of(self, windows: _Windows, one: np.uint64, text: bytes) -> np.ndarray:
        """Numbers of the items that have this window, compared byte by byte."""
        at = int(np.searchsorted(windows.one, one))
        while at < len(windows.one) and windows.one[at] == one:
            place = int(windows.place[at])
            if self.text.startswith(text, place) and self.text[place + len(text)] in b" \n":
                return windows.item[windows.bounds[at] : windows.bounds[at + 1]]
            at += 1
        return windows.item[:0]

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, which are hit, and the items with occurring windows."""
        words = Words(texts, ALNUM, lower=True)
        hashed, first = words.hashes(), words.first
        hit = np.zeros(len(hashed), bool)
        found: dict[int, set[int]] = {}
        for windows in self.lengths:
            n = windows.length
            start = windows.probable(hashed, np.flatnonzero(runs_inside(first, n)))
            keys = run_hashes(hashed, n)[start]
            real = []
            for s, key, doc in zip(start.tolist(), keys, (np.searchsorted(first, start, "right") - 1).tolist(), strict=True):
                items = self.items_of(windows, key, b" ".join(words.bytes_of(i) for i in range(s, s + n)))
                if len(items):
                    real.append(s)
                    found.setdefault(doc, set()).update(items.tolist())
            hit |= cover(np.array(real, np.int64), n, len(hashed))
        for i in range(len(texts)):
            yield int(first[i + 1] - first[i]), hit[first[i] : first[i + 1]], {self.names[k] for k in found.get(i, ())}


def _spans(hit: np.ndarray) -> list[int]:
    """Begin and end of each run of hit words, one after the other."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text")
    ).where(F.length("text") > 0)
    size = rows.agg(F.sum(F.length("text") + 32)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    if n == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(2 * n)) == i) for i in range(2 * n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    ws: Workspace,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What of each document occurs in the benchmark.

    Returns the input row as struct ``row`` and ``n_words``, ``spans`` (begin and end of
    each hit run of words), ``n_hit``, ``items`` (ids as strings, distinct).

    Defined cases: a null text has no words; empty items have no windows; an item without
    an id counts under the empty id; repeated items count once; empty tables work; other
    columns of either table are carried or ignored, whatever their names.
    """
    spark = docs.sparkSession
    state = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
    )
    blocks = _blocks(benchmark, item_id_col, item_text_col, block_bytes)
    for i, block in enumerate(blocks):
        index = spark.sparkContext.broadcast(Fingerprints([(r.item, bytes(r.text)) for r in block.collect()]))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = binaries(batch["text"])
                spans, items = batch["spans"].to_pylist(), batch["items"].to_pylist()
                n_words, n_hit = [], []
                for lo, hi in slices(texts, STEP_BYTES):
                    for k, (n, hit, found) in enumerate(index.value.hits(texts[lo:hi]), lo):
                        for a, b in zip(spans[k][::2], spans[k][1::2], strict=True):
                            hit[a:b] = True
                        n_words.append(n)
                        n_hit.append(int(hit.sum()))
                        spans[k] = _spans(hit)
                        if found:
                            items[k] = sorted({*items[k], *found})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row"],
                        batch["text"],
                        pa.array(spans, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.string())),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                    ],
                    names=["row", "text", "spans", "items", "n_words", "n_hit"],
                )

        state = state.mapInArrow(find, T.StructType([T.StructField(f.name, f.dataType) for f in state.schema]))
        if len(blocks) > 1:
            state = ws.write(state, f"block{i}")
            if i:
                ws.drop(f"block{i - 1}")
    return state.drop("text")


def is_contaminated() -> F.Column:
    """The contract's rule: at least one word is hit, and at least a twentieth of all."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs``, all columns, that the rule does not call contaminated."""
    return contamination(docs, benchmark, ws).where(~is_contaminated()).select("row.*")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "op3"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
