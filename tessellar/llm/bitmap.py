"""A bitmap over hashes of keys: which rows may be in a set, wherever they are read.

It has some bits for each key, from a least to a most size: what is broadcast has a bound. A
false hit is for the caller to sort out; beyond the bound there are more of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From 128 KB to 64 MB, at 16 bits or more for each key in between.
LEAST_BITS, MOST_BITS, EACH = 1 << 20, 1 << 29, 16


def bits_for(keys: int) -> int:
    """The size for so many keys: a power of two."""
    return min(max(LEAST_BITS, 1 << (EACH * keys).bit_length()), MOST_BITS)


def bitmap_of(slots: DataFrame, bits: int, column: str = "slot") -> np.ndarray:
    """One bit for each slot (1 to ``bits``) in the column; a bounded number of fixed-size rows reach the driver."""
    out = np.zeros(bits // 8, np.uint8)
    slot = F.col(column)
    parts = slots.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    for r in parts.collect():
        piece = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.part - 1) * len(piece)
        out[at : at + len(piece)] |= piece[: max(0, len(out) - at)]
    return out


def has(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is set."""
    at = slot - 1
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is surely not among ``keys``, and those where it may be; native, without a shuffle of rows.

    Pieces of the bitmap (4 KB each) are broadcast and met by their number.
    """
    size = bits_for(keys.count())
    slot = F.pmod(F.xxhash64(key), F.lit(size)) + 1
    pieces = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_at & 7 as int)) & 1")
    met = rows.join(F.broadcast(pieces), F.bitmap_bucket_number(slot) == F.col("_piece"), "left").withColumns({"_byte": byte, "_at": at})
    hit = F.coalesce(bit == 1, F.lit(False))
    return tuple(met.where(test).select(*[F.col(f"`{c}`") for c in rows.columns]) for test in (~hit, hit))
