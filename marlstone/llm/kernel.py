"""Vectorised byte and word kernels over Arrow string buffers.

All hashes are differences of prefix sums modulo 2**64, ``sum(T[x_i] * B**i)`` with random 64-bit ``T``
and odd ``B``, moved to a common origin by a power of ``B``'s inverse and finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_T = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}
#: bytes for which ``[^\x20\x09-\x0D]`` fails
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: documents are handled in groups of about this many bytes, whatever the size of an Arrow batch
GROUP = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        m = max(n, GROUP + 4096)
        for name, base in (("up", _B), ("down", _BINV)):
            x = np.full(m, base, U64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _POW[name] = x
        _POW["n"] = m
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Prefix sums of a sequence; ``at(lo, hi)`` is a hash of each ``seq[lo:hi]``."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = _powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Prefix:
        return cls(_T[data])

    def raw(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self._down[lo]

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(self.raw(lo, hi) + (hi - lo).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, q: int) -> np.ndarray:
        """Hash of every stretch of ``q`` symbols."""
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, U64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    n = len(col)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if offs is not None and n else np.zeros(n + 1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def groups(offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the given bytes
    end: np.ndarray
    first: np.ndarray  # n+1: index of each text's first word


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of texts laid end to end: maximal runs of bytes that are not white space."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    ink = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = ink[1:] != ink[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = ink[cuts[:-1]]
    start, end = cuts[:-1][keep], cuts[1:][keep]
    return Words(start, end, np.searchsorted(start, offsets).astype(np.int64))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """One 64-bit hash for each word, in blocks, so that a huge text needs no huge tables."""
    out = np.empty(len(w.start), U64)
    lo = 0
    while lo < len(out):
        base = w.start[lo]
        hi = max(lo + 1, int(np.searchsorted(w.end, base + GROUP, "right")))
        p = Prefix.of_bytes(data[base : w.end[hi - 1]])
        out[lo:hi] = p.at(w.start[lo:hi] - base, w.end[lo:hi] - base)
        lo = hi
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``start[i] .. start[i]+length[i]-1``, laid end to end."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(np.asarray(start, np.int64) - (ends - length), length)
    return out


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of n positions that lie in any ``lo[i]:hi[i]``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:n]) > 0
