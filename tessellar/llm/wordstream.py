"""Words of many texts as numpy arrays: where they are, 64-bit hashes, hashes of runs of words.

Texts are bytes (UTF-8). A batch of texts becomes one buffer with a separator after
each text, so all per-character work is a handful of vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of a buffer that are hashed at once; bounds the 8-byte temporaries.
HASH_STEP = 1 << 20
#: Odd multipliers of the polynomial hash over bytes and of the one over words.
BYTE_BASE, BYTE_BASE_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD_BASE = 0xD6E8FEB86659FD93

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _random.integers(0, 1 << 64, 256, dtype=U64)


def _space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased text."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


SPACED, ALNUM = _space_separated(), _alphanumeric()
#: For bytes.translate: A-Z to a-z, all else unchanged.
LOWER_AZ = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of a list of texts.

    ``start``, ``end``: byte positions in ``buffer``; ``first``: for each text the number
    of its first word, and at last the number of all words.
    """

    def __init__(self, texts: Sequence[bytes], is_word: np.ndarray = SPACED, lower: bool = False):
        joined = b"\n".join([*texts, b""])
        self.buffer = joined.translate(LOWER_AZ) if lower else joined
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = is_word[raw]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, begins)
        self.raw = raw

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, equal in every process."""
        out = np.empty(len(self), U64)
        at = 0
        while at < len(self):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + HASH_STEP)))
            hi = self.end[to - 1]
            power, inverse = _powers(int(hi - lo) + 1)
            total = np.zeros(int(hi - lo) + 1, U64)
            np.cumsum(_BYTE_CODE[self.raw[lo:hi]] * power[: hi - lo], out=total[1:])
            a, b = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(U64) * U64(WORD_BASE))
            at = to
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the byte base and of its inverse; kept up to the usual step."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (BYTE_BASE, BYTE_BASE_INVERSE):
        p = np.full(n, base, U64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=U64))
    if n <= 2 * HASH_STEP:
        _POWERS[:] = made
    return made[0], made[1]


def run_hashes(word: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive numbers; one fewer than ``length`` fewer values."""
    n = len(word) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, (seed * 0x2545F4914F6CDD1D + length) % (1 << 64), U64)
    factor = 1
    for j in range(length):
        factor = factor * (WORD_BASE + 2 * seed) % (1 << 64)
        total += word[j : j + n] * U64(factor)
    return mix64(total)


def runs_inside(first: np.ndarray, length: int) -> np.ndarray:
    """Which of ``run_hashes`` lie within one text. ``first`` as in ``Words``."""
    n = int(first[-1]) - length + 1
    if n <= 0:
        return np.empty(0, bool)
    inside = np.ones(n, bool)
    for j in range(1, length):
        crossing = first[1:-1] - j
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    # a text boundary at word b lies inside the runs that begin in (b - length, b)
    return inside


def cover(start: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run of ``length`` words that begins at one of ``start``."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, np.minimum(start + length, size), -1)
    return np.cumsum(change[:-1]) > 0


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: Sequence[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together (a longer text has a range of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def parts_of(column: pa.Array, most: int) -> Iterator[pa.Array]:
    """The column in consecutive parts of at most ``most`` bytes of text (a longer text is a part of its own)."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(column):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi
