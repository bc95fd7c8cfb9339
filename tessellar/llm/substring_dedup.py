"""Substring deduplication by fixed-block anchors (operator 4).

A window of 13 words holds exactly one whole block of 7 words that begins at a multiple
of 7 in its document. So it is enough to index those non-overlapping blocks of every
document and to probe the index with every rolling run of 7 words: wherever two
documents share a window, the later one's probe hits the earlier one's block.

1. Anchors. Each batch sends, by key range, 4 bytes for each distinct rolling run, a bit
   for "begins a block" and one for "in several documents here". A run is hot if it is a
   block somewhere and occurs in two documents; a bit for each run goes back. A chance
   equality here only makes more candidates.
2. Extension. Each hot anchor is extended to the windows around it; only those windows,
   by a 96-bit hash, are sent with the least document that has them, and
   the least document of the whole corpus comes back.
3. Removal. A window whose sequence begins in a document with a smaller id is removed;
   windows that follow one another add up to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessellar.llm.exchange import BATCH_BYTES, Batches, answer, cut, found_in, grouped, grouped_pairs, joined, range_of
from tessellar.llm.wordstream import Words, binaries, cover, run_hashes, runs_inside
from tessellar.llm.workspace import Workspace

WINDOW, BLOCK = 13, 7
#: A document without id comes after all that have one.
_NO_ID = np.iinfo(np.int64).max


class _Batch:
    """Words of a batch's texts, and of each word its document."""

    def __init__(self, table: pa.Table):
        self.number = table["batch"][0].as_py()
        self.texts = binaries(table["text"])
        ids = table["doc_id"].fill_null(_NO_ID).to_numpy()
        self.words = Words(self.texts)
        self.hash = self.words.hashes()
        self.doc = ids[self.words.text_of_word()]

    def runs(self, length: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs that lie within a document, and where they begin."""
        at = np.flatnonzero(runs_inside(self.words.first, length))
        return run_hashes(self.hash, length, seed)[at], at


def _anchors(parts: int, block: int) -> Callable[[pa.Table], pa.Table]:
    def send(table: pa.Table) -> pa.Table:
        batch = _Batch(table)
        key, at = batch.runs(block)
        offset = at - np.repeat(batch.words.first[:-1], np.diff(batch.words.first))[at]
        order, begin = grouped(key)
        doc = batch.doc[at][order]
        key, is_block = key[order][begin], (offset % block == 0)[order]
        if len(begin):
            several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
            is_block = np.logical_or.reduceat(is_block, begin)
        else:
            several = is_block = np.zeros(0, bool)
        return cut(
            key,
            parts,
            batch.number,
            [
                ("low", lambda a, b: key[a:b].astype(np.uint32).tobytes()),
                ("block", lambda a, b: np.packbits(is_block[a:b]).tobytes()),
                ("several", lambda a, b: np.packbits(several[a:b]).tobytes()),
            ],
        )

    return send


def _bits(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    """The bits of all blobs, one after the other."""
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(packed, sizes, strict=True)]).astype(bool)


def _hot(table: pa.Table) -> pa.Table:
    """Which runs of each blob are a block somewhere and occur in two documents."""
    lows, blocks, several = (table[c].to_pylist() for c in ("low", "block", "several"))
    sizes = [len(x) // 4 for x in lows]
    order, begin = grouped(joined(lows, np.uint32))
    count = np.diff(np.append(begin, len(order)))
    hot = np.logical_or.reduceat(_bits(blocks, sizes)[order], begin)
    hot &= (count > 1) | np.logical_or.reduceat(_bits(several, sizes)[order], begin)
    back = np.empty(len(order), bool)
    back[order] = np.repeat(hot, count)
    pieces = [np.packbits(x).tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])]
    return pa.Table.from_arrays([table["batch"], table["part"], pa.array(pieces, pa.binary())], names=["batch", "part", "hot"])


def _windows(parts: int, window: int, block: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(table: pa.Table, hot: pa.Table) -> pa.Table:
        batch = _Batch(table)
        key, at = batch.runs(block)
        order, begin = grouped(key)
        distinct = key[order][begin]
        # answers of all ranges, in their order, are bits for the distinct keys in theirs
        answers = sorted(zip(hot["part"].to_pylist(), hot["hot"].to_pylist(), strict=True))
        bounds = np.searchsorted(range_of(distinct, parts), np.arange(parts + 1, dtype=np.uint64))
        is_hot = np.zeros(len(distinct), bool)
        for part, bits in answers:
            a, b = bounds[part], bounds[part + 1]
            is_hot[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a))
        anchored = np.zeros(len(batch.hash) + 1, np.int32)
        anchored[at[order] + 1] = np.repeat(is_hot, np.diff(np.append(begin, len(order))))
        anchored = np.cumsum(anchored)
        start = np.flatnonzero(runs_inside(batch.words.first, window))
        start = start[anchored[start + window - block + 1] > anchored[start]]
        one, two = (run_hashes(batch.hash, window, seed)[start] for seed in (0, 1))
        two = two.astype(np.uint32)
        order, begin = grouped_pairs(one, two)
        doc = batch.doc[start][order]
        least, most = (f.reduceat(doc, begin) if len(begin) else doc for f in (np.minimum, np.maximum))
        one, two, several = one[order][begin], two[order][begin], least != most
        return cut(
            one,
            parts,
            batch.number,
            [
                ("one", lambda a, b: one[a:b].tobytes()),
                ("two", lambda a, b: two[a:b].tobytes()),
                ("least", lambda a, b: least[a:b].tobytes()),
                ("several", lambda a, b: np.packbits(several[a:b]).tobytes()),
            ],
        )

    return send


def _least(table: pa.Table) -> pa.Table:
    """For each blob, the windows that some document of its batch is not the first to have, and the first."""
    ones = table["one"].to_pylist()
    one, two = joined(ones, np.uint64), joined(table["two"].to_pylist(), np.uint32)
    least = joined(table["least"].to_pylist(), np.int64)
    several = _bits(table["several"].to_pylist(), [len(x) // 8 for x in ones])
    order, begin = grouped_pairs(one, two)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(least[order], begin), np.diff(np.append(begin, len(order))))
    told = several | (first < least)
    ends = np.cumsum([len(x) // 8 for x in ones])
    rows = []
    for batch, lo, hi in zip(table["batch"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
        pick = np.flatnonzero(told[lo:hi]) + lo
        if len(pick):
            rows.append((batch, one[pick].tobytes(), two[pick].tobytes(), first[pick].tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["batch", "one", "two", "first"]
    )


def _removal(window: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        batch = _Batch(table)
        one, two, first = (joined(told[c].to_pylist(), k) for c, k in (("one", np.uint64), ("two", np.uint32), ("first", np.int64)))
        order = np.argsort(one)
        one, two, first = one[order], two[order], first[order]
        start = np.flatnonzero(runs_inside(batch.words.first, window))
        key = run_hashes(batch.hash, window, 0)[start]
        hit, at = found_in(key, one)
        start, key, at = start[hit], key[hit], at[hit]
        same, gone, open_ = run_hashes(batch.hash, window, 1)[start].astype(np.uint32), np.zeros(len(start), bool), np.arange(len(start))
        while len(open_):  # again only where windows differ but share their first 64 bits
            place = at[open_]
            gone[open_] |= (two[place] == same[open_]) & (first[place] < batch.doc[start[open_]])
            at[open_] += 1
            open_ = open_[at[open_] < len(one)]
            open_ = open_[one[at[open_]] == key[open_]]
        removed = cover(start[gone], window, len(batch.hash))
        bounds = batch.words.first
        counts = np.concatenate([[0], np.cumsum(removed)])
        digests, kept_texts = [], []
        for i, text in enumerate(batch.texts):
            words = text.split()
            a, b = bounds[i], bounds[i + 1]
            if counts[b] > counts[a]:
                words = compress(words, ~removed[a:b])
            kept = b" ".join(words)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept)
        arrays = [
            table["doc_id"],
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(np.diff(counts[bounds]), pa.int64()),
            pa.array(digests, pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.Table.from_arrays(arrays, names=names)

    return remove


def substring_dedup(
    docs: DataFrame,
    ws: Workspace,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_text: bool = False,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Remove the words of every window that also begins in a document with a smaller id.

    Returns a row for each input row: ``doc_id, n_words, n_removed, kept_sha256``, and
    ``kept_text`` (kept words joined by one space) if asked for.

    Defined cases: a null text has no words; a document shorter than a window keeps all;
    repeats within a document, or between rows of one id, are kept; rows without id come
    after all others and are equal to one another; an empty table gives an empty result;
    other columns are not read.
    """
    block = (window + 1) // 2
    batches = Batches(docs, ws, id_col, text_col, batch_bytes)
    runs = batches.ask(_anchors(batches.parts, block), "part long, batch long, low binary, block binary, several binary")
    hot = answer(runs, batches.parts, _hot, "batch long, part long, hot binary")
    windows = batches.ask(
        _windows(batches.parts, window, block), "part long, batch long, one binary, two binary, least binary, several binary", ws.write(hot, "hot")
    )
    told = ws.write(answer(windows, batches.parts, _least, "batch long, one binary, two binary, first binary"), "told")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    result = ws.write(batches.ask(_removal(window, with_text), schema, told), "result")
    ws.keep_only("result")
    return result


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, windows of 13 words."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op4"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, s, array_to_string(w[s : s + 12], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)
), gone AS (
  SELECT DISTINCT r, unnest(range(s, s + 13)) AS p
  FROM (SELECT r, doc_id, s, min(doc_id) OVER (PARTITION BY t) AS first FROM win) WHERE first < doc_id
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
