"""Anchored contexts: the compacted form of all windows of a text.

A window is ``length`` consecutive symbols. Its anchor is the leftmost of its ``gram``-symbol stretches with the
smallest hash, which depends on the window's content alone, so equal windows have equal anchors at equal
places. A context is a maximal run of consecutive windows with one anchor: a nonbranching path of the graph whose
edges are the windows. Two equal contexts hold the same windows; windows of contexts with different anchors differ.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from marlstone.llm.kernel import U64, Prefix, mix


class Contexts(NamedTuple):
    row: np.ndarray  # index of the text
    start: np.ndarray  # first window's first symbol, counted in the text
    count: np.ndarray  # windows in the run
    anchor: np.ndarray  # the anchor's place, in the symbols given
    gram: np.ndarray  # hash of the anchor's symbols
    whole: np.ndarray  # hash of all symbols that the windows cover, and of the anchor's place among them


SLICE = 1 << 20


def _argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Leftmost place of the smallest key among each ``width`` neighbours."""
    val, pos = keys, np.arange(len(keys), dtype=np.int32)
    have = 1
    while have < width:
        step = min(have, width - have)
        left = val[: len(val) - step] <= val[step:]
        pos = np.where(left, pos[: len(pos) - step], pos[step:])
        val = np.where(left, val[: len(val) - step], val[step:])
        have += step
    return pos


def _slice(p: Prefix, offsets: np.ndarray, length: int, gram: int, base: int) -> Contexts:
    n = int(offsets[-1])
    if n < length:
        z = np.zeros(0, np.int64)
        return Contexts(z, z, z, z, z.astype(U64), z.astype(U64))
    grams = p.grams(gram)[: n - gram + 1] if n - gram + 1 <= len(p.sums) - gram else p.grams(gram)
    if len(grams) < n - gram + 1:  # the last stretch
        lo = np.arange(len(grams), n - gram + 1)
        grams = np.concatenate([grams, mix(p.raw(lo, lo + gram))])
    pos = _argmin((grams >> U64(32)).astype(np.uint32), length - gram + 1)
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(pos)]
    ok = np.arange(len(pos)) <= (offsets[1:] - length)[row_of]
    new = ok.copy()
    new[1:] &= (pos[1:] != pos[:-1]) | ~ok[:-1] | (row_of[1:] != row_of[:-1])
    first = np.flatnonzero(new)
    stop = np.zeros(len(pos), bool)
    stop[:-1] = ok[:-1] & (~ok[1:] | new[1:])
    stop[-1] = ok[-1]
    last = np.flatnonzero(stop)
    row, at = row_of[first].astype(np.int64), pos[first].astype(np.int64)
    end = last + length
    whole = mix(p.raw(first, end) + (at - first).astype(U64) * U64(0xA24BAED4963EE407) + (end - first).astype(U64) * U64(0x9FB21C651E98DF25))
    return Contexts(row, first - offsets[row] + base, last - first + 1, at, grams[at], whole)


def contexts(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Contexts:
    """Contexts of texts laid end to end. ``values``: 64 random-looking bits for each symbol.

    A text of over SLICE symbols is taken in slices of window starts, so memory stays bounded; a run that a
    slice ends is two contexts then, which costs an expansion later and changes no result.
    """
    if int(offsets[-1]) <= 2 * SLICE or len(offsets) > 2:
        return _slice(Prefix(values), offsets, length, gram, 0)
    parts, n = [], int(offsets[-1])
    for lo in range(0, n - length + 1, SLICE):
        hi = min(n, lo + SLICE + length - 1)
        c = _slice(Prefix(values[lo:hi]), np.array([0, hi - lo]), length, gram, lo)
        parts.append(c._replace(anchor=c.anchor + lo))
    return Contexts(*(np.concatenate(x) for x in zip(*parts, strict=True)))
