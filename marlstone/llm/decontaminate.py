"""Benchmark decontamination by templates.

Texts become canonical tokens: letter and digit runs in lower case (A-Z and the Latin-1 capitals), where numbers,
names and units are typed placeholders. A number starts with a digit or is a number word; a unit is one of a list; a
name is a capitalised word inside a sentence, or at its start if the text has it inside one, too; names in a row are one. Windows of five tokens are hashed and joined with
the windows of the benchmark items. A document that holds at least 0.8 of an item's distinct windows, within one stretch
of text of about the item's length, is a candidate. Its slots are then compared: wherever the item repeats a number,
name or unit, the document must repeat its own (in at least 0.8 of the places). So a copy is found whatever its case and
punctuation, and also where its numbers or names were replaced throughout.

The item windows are broadcast while they number at most BROADCAST_WINDOWS; beyond it, documents' windows that pass a
broadcast filter of a fixed size are shuffled and joined on the hash. Time is linear in a text's length, however long it is. Different texts under one item_id are items of their own. Texts shorter than five tokens are one window of all their tokens, so such an item matches a text that says nothing else;
items without tokens, and rows
without an id, match nothing. Null texts hold nothing. Repeated rows give one result. Ties count as reached. An empty table
gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import kernel
from marlstone.llm.kernel import U64, Prefix
from marlstone.llm.session import cut, prepare, table

WINDOW = 5
SHARE = 0.8
BROADCAST_WINDOWS = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_STOP = np.zeros(256, np.int32)
_STOP[[10, 33, 46, 63]] = 1
NUM, UNIT, NAME = (U64(x) for x in (0x1111_2222_3333_4441, 0x1111_2222_3333_4442, 0x1111_2222_3333_4443))
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty fifty hundred thousand million zwei drei vier fünf sechs sieben acht neun zehn deux trois quatre cinq sept huit neuf dix dos tres cuatro cinco seis siete ocho nueve diez"
UNIT_WORDS = "km kg cm mm mg ml lb lbs oz ft mph kmh kilometers kilometres kilograms meters metres grams liters litres miles feet inches pounds dollars euros cents hours minutes seconds days weeks months years percent degrees"


def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    return np.sort(kernel.word_hashes(data, kernel.words(data, np.array([0, len(data)]))))


class _Few:
    """Membership among few hashes, with a cheap first look."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values, self.mask = values, U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(values & self.mask).astype(np.int64)] = True

    def where(self, x: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(x & self.mask).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == x[maybe]]


_NUMBERS, _UNITS = _Few(_hashes(NUMBER_WORDS), 16), _Few(_hashes(UNIT_WORDS), 16)


class Tokens(NamedTuple):
    code: np.ndarray  # canonical hash
    value: np.ndarray  # hash of the word as it stands, in lower case
    slot: np.ndarray  # True for placeholders
    first: np.ndarray  # n+1: index of each text's first token


def lower(data: np.ndarray) -> np.ndarray:
    out = kernel.lower_ascii(data)
    if len(out) > 1:
        wide = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:] += wide.astype(np.uint8) * np.uint8(32)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = kernel.words(data, offsets, ~_LETTER)
    low = lower(data)
    value = kernel.word_hashes(low, w)
    code = value.copy()
    n = len(value)
    if not n:
        return Tokens(code, value, np.zeros(0, bool), w.first)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    head = np.zeros(n, bool)
    head[w.first[:-1][w.first[:-1] < n]] = True
    gap_lo = np.concatenate([[0], w.end[:-1]])
    begins = head | (stops[w.start] > stops[np.minimum(gap_lo, w.start)])
    c0, c1 = data[w.start], data[np.minimum(w.start + 1, len(data) - 1)]
    l1 = low[np.minimum(w.start + 1, len(data) - 1)]
    capital = ((c0 >= 65) & (c0 <= 90)) | ((c0 == 0xC3) & (c1 != l1) & (w.end - w.start > 1))
    nxt = np.minimum(w.start + 1 + (c0 == 0xC3), len(data) - 1)
    shout = (w.end - w.start > 1 + (c0 == 0xC3)) & (data[nxt] >= 65) & (data[nxt] <= 90)
    digit = (c0 >= 48) & (c0 <= 57)
    digit[_NUMBERS.where(value)] = True
    unit = np.zeros(n, bool)
    unit[_UNITS.where(value)] = True
    name = capital & ~begins & ~shout & ~digit & ~unit & (w.end - w.start > 1 + (c0 == 0xC3))
    mark = value ^ kernel.mix(np.repeat(np.arange(len(w.first) - 1), np.diff(w.first)).astype(U64))
    maybe = np.flatnonzero(capital & begins & ~shout & ~digit & ~unit)
    name[maybe[np.isin(mark[maybe], mark[name])]] = True
    code[digit], code[unit], code[name] = NUM, UNIT, NAME
    keep = np.ones(n, bool)
    mark = data[np.maximum(w.start - 1, 0)]
    glued = (w.start - gap_lo == 1) & ((mark == 46) | (mark == 44)) & ~head
    num = (c0 >= 48) & (c0 <= 57)
    keep[1:] &= ~(glued[1:] & num[1:] & num[:-1])
    keep[1:] &= ~(name[1:] & name[:-1] & ~head[1:])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Tokens(code[keep], value[keep], (digit | unit | name)[keep], kept[w.first])


def windows(t: Tokens, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in it) of each window; a text of fewer tokens is one window."""
    n = np.diff(t.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    lo = kernel.spans(t.first[:-1], count)
    hi = lo + np.minimum(size, np.repeat(n, count))
    out = np.empty(len(lo), U64)
    for a in range(0, len(lo), kernel.GROUP):
        z = min(a + kernel.GROUP, len(lo))
        base, top = lo[a], hi[z - 1]
        out[a:z] = Prefix(t.code[base:top]).at(lo[a:z] - base, hi[a:z] - base)
    row = np.repeat(np.arange(len(n)), count)
    return out, row, lo - t.first[:-1][row]


def laid(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


class Items:
    """Windows of benchmark items, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = np.array(ids, np.int64)
        self.t = tokens(*laid(texts))
        h, row, at = windows(self.t)
        order = np.argsort(h, kind="stable")
        self.hash, self.row, self.at = h[order], row[order], at[order]
        new = np.append(True, self.hash[1:] != self.hash[:-1]) if len(h) else np.zeros(0, bool)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(h)))
        self.index = _Few(self.hash[self.start], max(12, min(24, int(len(self.start)).bit_length() + 6)))
        self.need = np.bincount(row[np.unique(np.stack([row.astype(U64), h]), axis=1, return_index=True)[1]] if len(h) else row, minlength=len(ids))

    def hits(self, h: np.ndarray, row: np.ndarray, at: np.ndarray):
        """(text, item, place in text, place in item) of equal windows."""
        found = self.index.where(h)
        k = np.searchsorted(self.index.values, h[found])
        times = self.size[k] if len(found) else np.zeros(0, np.int64)
        which = kernel.spans(self.start[k], times) if len(found) else np.zeros(0, np.int64)
        rep = np.repeat(found, times)
        return row[rep], self.row[which], at[rep], self.at[which]


def distinct(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many values code[k : ends[k]] holds, for each k; ``ends`` never falls."""
    out, held, now, hi = [], [0] * (int(code.max(initial=-1)) + 1), 0, 0
    code = code.tolist()
    for c, end in zip(code, ends.tolist(), strict=True):
        for x in code[hi:end]:
            now += not held[x]
            held[x] += 1
        hi = end
        out.append(now)
        held[c] -= 1
        now -= not held[c]
    return np.array(out, np.int64)


def judge(t: Tokens, text: int, items: Items, item: int, at: np.ndarray, item_at: np.ndarray, share: float = SHARE):
    """(distinct windows matched, slots that changed) if the text holds the item, else None.

    Each stretch that reaches the share is judged, those with the most distinct windows first.
    """
    m = int(items.t.first[item + 1] - items.t.first[item])
    width = max(WINDOW, m // 4)
    shift = at - item_at
    order = np.argsort(shift, kind="stable")
    shift, at, item_at = shift[order], at[order], item_at[order]
    base_i, base_t = int(items.t.first[item]), int(t.first[text])
    ends = np.searchsorted(shift, shift + width, "right")
    own = windows(Tokens(items.t.code[base_i : base_i + m], items.t.value[base_i : base_i + m], items.t.slot[base_i : base_i + m], np.array([0, m])))[0]
    values, code = np.unique(own[item_at], return_inverse=True)
    if len(values) < share * items.need[item]:
        return None
    count = distinct(code, ends)
    for lo in np.argsort(-count, kind="stable").tolist():
        got, hi = int(count[lo]), int(ends[lo])
        if got < share * items.need[item]:
            break
        ti = (item_at[lo:hi, None] + np.arange(min(WINDOW, m))).ravel()
        td = (at[lo:hi, None] + np.arange(min(WINDOW, m))).ravel()
        ti, pick = np.unique(ti, return_index=True)
        td = td[pick]
        slot = items.t.slot[base_i + ti]
        a, b = items.t.value[base_i + ti][slot], t.value[base_t + td][slot]
        if len(a):
            pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True)
            best = {}
            for x, c in zip(pairs[0].tolist(), n.tolist(), strict=True):
                best[x] = max(best.get(x, 0), c)
            if sum(best.values()) < share * len(a):
                continue
        return got, int((a != b).sum())
    return None


_OUT = "doc_id long, item_id long, n_windows long, n_matched long, n_changed long"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_windows", "n_matched", "n_changed"])


def _find(items: Items, share: float):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offs = kernel.buffers(b.column(1))
            out = []
            for lo, hi in kernel.groups(offs):
                t = tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                text, item, at, item_at = items.hits(*windows(t))
                if not len(text):
                    continue
                key = text * len(items.ids) + item
                order = np.argsort(key, kind="stable")
                key, at, item_at = key[order], at[order], item_at[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                stop = np.append(start[1:], len(key))
                for a, z in zip(start.tolist(), stop.tolist(), strict=True):
                    text, item = divmod(int(key[a]), len(items.ids))
                    if z - a >= share * items.need[item] and (got := judge(t, text, items, item, at[a:z], item_at[a:z], share)):
                        out.append((int(ids[lo + text]), int(items.ids[item]), int(items.need[item]), *got))
            yield _rows(out)

    return run


#: bits of the filter that documents' windows pass before they travel
FILTER_BITS = 27


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """A bit for each low part of a hash that occurs: at most 2**FILTER_BITS bits reach the driver, however many hashes there are."""
    low = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    word = hashes.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, CAST((hash & {(1 << FILTER_BITS) - 1}) & 63 AS INT))").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in word.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _explode(keys: list[str], known=None):
    """Distinct windows of each text: the columns named, then hash. The text is the last column read.

    ``known``: a broadcast filter; windows that no item can have are left out.
    """

    def run(batches):
        for b in batches:
            data, offs = kernel.buffers(b.column(len(keys)))
            for lo, hi in kernel.groups(offs):
                h, row, _ = windows(tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                if known is not None:
                    maybe = known.value[(h & U64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                    h, row = h[maybe], row[maybe]
                pairs = np.unique(np.stack([row.astype(U64), h]), axis=1)
                at = pa.array(pairs[0].astype(np.int64) + lo)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keys))), pa.array(pairs[1].view(np.int64))], names=[*keys, "hash"])

    return run


def _verify(share: float):
    def run(batches):
        for b in batches:
            out = []
            for doc, text, item, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                items, t = Items([item], [words]), tokens(*laid([text]))
                _, _, at, item_at = items.hits(*windows(t))
                if len(at) and (got := judge(t, 0, items, 0, at, item_at, share)):
                    out.append((doc, item, int(items.need[0]), *got))
            yield _rows(out)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows (distinct, of the item), n_matched, n_changed (slots) of documents that hold an item."""
    prepare(docs.sparkSession)
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size // 2 <= broadcast_windows:  # a token and its gap take two bytes at least
        rows = bench.orderBy("item_id", "text").collect()
        out = docs.mapInArrow(_find(Items([r.item_id for r in rows], [r.text for r in rows]), share), _OUT)
    else:
        bench = bench.withColumn("part", F.xxhash64("text"))  # texts that share an item_id are items of their own
        item = ["item_id", "part"]
        theirs = bench.select(*item, "text").mapInArrow(_explode(item), "item_id long, part long, hash long").distinct()
        theirs = cut(theirs)
        known = docs.sparkSession.sparkContext.broadcast(_filter_of(theirs))
        need = theirs.groupBy(item).agg(F.count("*").alias("need"))
        mine = docs.mapInArrow(_explode(["doc_id"], known), "doc_id long, hash long").distinct()
        pairs = mine.join(theirs, "hash").groupBy("doc_id", *item).agg(F.count("*").alias("n"))
        pairs = pairs.join(need, item).where(F.col("n") >= share * F.col("need")).select("doc_id", *item)
        both = docs.join(pairs, "doc_id").join(bench.withColumnRenamed("text", "words"), item).select("doc_id", "text", "item_id", "words")
        out = both.mapInArrow(_verify(share), _OUT)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.min("n_changed").alias("n_changed"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    bad = matches(docs, benchmark, share).select("doc_id").distinct()
    return docs.join(bad.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents", True), table(spark, sf_dir, "benchmark"))
