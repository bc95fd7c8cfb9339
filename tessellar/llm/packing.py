"""Packing of tokenised documents into sequences (operator 2).

Documents are tokenised once, in a map over the input, and cut into pieces of at most
one sequence; only a narrow row for each piece goes on. Pieces are dealt at random into
groups of bounded size and each group is packed by itself with first-fit decreasing: a
tournament tree over the bins' free space finds the first bin that fits in O(log bins).
A random group has the length distribution of the whole, so its padding is as small;
only its last few bins are partly empty.

Ids are those of the `tokenizers` file; they are computed by `tiktoken` from the ranks that
are in that file (three times as fast), after a check that its merges say the same.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellar.llm.workspace import Workspace

SEQUENCE, END_ID = 1024, 0
#: Pieces of a group that is packed in one task.
GROUP_PIECES = 8192
VOCABULARY = "byte_bpe_50k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ranks that say the same as the file's merges: each makes the token of the next id. None, if they do not."""
    pre = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer"):
        return None
    byte, special = _byte_of(), {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    made = sorted(ranks.values())[256:]
    for merge, i in zip(model["model"]["merges"], made, strict=True):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        if model["model"]["vocab"].get("".join(pair)) != i:
            return None
    return ranks


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids of the tokenizer file at ``path``, no special tokens added.

    Which library computes them depends on that file alone, so all executors do the same: a
    byte-level file whose merges are in the order of its ids is read as ranks by `tiktoken`,
    any other by `tokenizers`. The string of a special token in a text becomes that token's
    id, as the file says.
    """
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    ranks = _ranks(model)
    if ranks is not None:
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            if any(t in text for t in special):
                return np.array(fast.encode(text, allowed_special="all"), np.uint32)
            return fast.encode_to_numpy(text)

        return encode
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces_of(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise, end each document with ``end_id`` and cut it into full sequences and a rest."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), sequence):
                    piece = ids[at : at + sequence]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenise, PIECES)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, its bin and its offset there.

    A tournament tree keeps in each node the most free space of the bins below it. From
    the root, going left whenever that side has room ends at the first bin that fits.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1
    while leaves < len(rest):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    for i in rest:
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def pack(
    docs: DataFrame,
    ws: Workspace,
    vocabulary: str | None = None,
    sequence: int = SEQUENCE,
    group_pieces: int = GROUP_PIECES,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents; a row for each piece, see the module.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    ``sequence_id`` is unique over all groups; offsets of a sequence follow one another
    from 0 without gaps.

    Defined cases: a null or empty text is the single end id; null and repeated doc ids
    are packed like any others; an empty table gives an empty result; a document longer
    than a sequence fills whole ones and only its rest shares one; columns other than the
    two named are not read.
    """
    pieces = ws.write(pieces_of(docs, vocabulary or public_tokenizers.path(VOCABULARY), sequence, id_col=id_col, text_col=text_col), "pieces")
    n_groups = max(1, -(-pieces.count() // group_pieces))
    # the place in the written table, files told apart by the number in their name and not by its random part:
    # the same in every run over the same input, and different for equal rows
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    place = F.xxhash64(F.lit(seed), part, F.col("_metadata.row_index"))
    dealt = pieces.select("*", F.pmod(place, F.lit(n_groups)).alias("grp"), place.alias("place"))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), sequence)
        group = table["grp"][0].as_py()
        table = table.drop_columns(["grp", "place"])
        return table.append_column("sequence_id", pa.array(bins + (group << 24), pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64())
        )

    return dealt.groupBy("grp").applyInArrow(pack_group, f"{PIECES}, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, in sequences of 1024."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op2"))
