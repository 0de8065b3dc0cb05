"""Contexts of texts (see ``contexts``) that occur earlier, and those that may share windows with others.

Of equal contexts only the first occurrence stays open, all others are wholly repeated. Where different contexts share an
anchor they may share some windows; the open ones among those are given back to be looked at closer. Records of one task
are combined before they are shuffled: a class of thousands of equal contexts sends one record from each batch.

Rows that travel are packed blobs, ``(key, kind, blob)``; every key is reduced by itself, one after another, so memory
is that of one key. The number of keys grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import kernel
from marlstone.llm.contexts import contexts
from marlstone.llm.kernel import U64
from marlstone.llm.session import cut

PACKED = "key int, kind int, blob binary"
MARKS = "doc_id long, fp int, full binary, open binary"
RECORDS, FULL = 0, 1


class Rule(NamedTuple):
    """What a window is, and which earlier occurrences count."""

    length: int
    gram: int
    symbols: Callable  # (bytes, offsets) -> (64 bits for each symbol, offsets counted in symbols)
    same_doc: bool  # earlier starts in the same document count, too


def of_bytes(data: np.ndarray, offsets: np.ndarray):
    return kernel._T[data], offsets


def of_words(data: np.ndarray, offsets: np.ndarray):
    w = kernel.words(data, offsets)
    return kernel.word_hashes(data, w), w.first


_COLS = (("k32", np.uint32), ("k64", np.uint64), ("start", np.int32), ("count", np.int32))


class Recs(NamedTuple):
    k32: np.ndarray
    k64: np.ndarray
    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    fp: np.ndarray

    def take(self, at) -> Recs:
        return Recs(*(x[at] for x in self))

    def pack(self) -> bytes:
        """Columns one after another; (doc, fp) once for each run of records."""
        n = len(self.doc)
        new = np.ones(n, bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.fp[1:] != self.fp[:-1])
        runs = np.flatnonzero(new)
        cols = [np.array([n, len(runs)], np.int64), self.doc[runs].astype(np.int64), self.fp[runs].astype(np.int32), np.diff(np.append(runs, n)).astype(np.int32)]
        wide = int(self.count.max(initial=0)) > 255
        cols += [self.k32.astype(np.uint32), self.k64.astype(np.uint64), self.start.astype(np.int32), np.array([wide], np.uint8), self.count.astype(np.int32 if wide else np.uint8)]
        return b"".join(x.tobytes() for x in cols)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Recs:
        parts = []
        for b in blobs:
            n, r = np.frombuffer(b, np.int64, 2)
            at, got = 16, []
            for dtype, k in ((np.int64, r), (np.int32, r), (np.int32, r), (np.uint32, n), (np.uint64, n), (np.int32, n)):
                got.append(np.frombuffer(b, dtype, k, at))
                at += int(k) * np.dtype(dtype).itemsize
            count = np.frombuffer(b, np.int32 if b[at] else np.uint8, n, at + 1).astype(np.int32)
            doc, fp, reps, k32, k64, start = got
            parts.append((k32, k64, start, count, np.repeat(doc, reps), np.repeat(fp, reps)))
        if not parts:
            return cls(*(np.zeros(0, t) for t in (np.uint32, np.uint64, np.int32, np.int32, np.int64, np.int32)))
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _classes(r: Recs) -> tuple[Recs, np.ndarray, np.ndarray]:
    """Records that share their k32 with others, sorted by key after key: k32 for all, the rest for ties.

    Returns them, the start of each class (equal k32 and k64) and of each k32 group, as marks on the rows.
    """
    order = np.argsort(r.k32)
    k = r.k32[order]
    same = k[1:] == k[:-1]
    tied = np.zeros(len(k), bool)
    tied[1:] |= same
    tied[:-1] |= same
    r = r.take(order[tied])
    r = r.take(np.lexsort((r.start, r.doc, r.k64, r.k32)))
    group = np.ones(len(r.doc), bool)
    group[1:] = r.k32[1:] != r.k32[:-1]
    cls = group.copy()
    cls[1:] |= r.k64[1:] != r.k64[:-1]
    return r, cls, group


def _repeated(r: Recs, cls: np.ndarray, same_doc: bool) -> np.ndarray:
    """True where the class has an earlier occurrence. Classes are sorted by (doc, start)."""
    first = np.flatnonzero(cls)[np.cumsum(cls) - 1] if len(cls) else np.zeros(0, int)
    later = r.doc != r.doc[first]
    if same_doc:
        later |= r.start != r.start[first]
    return later


def _combined(r: Recs, same_doc: bool) -> tuple[Recs, Recs]:
    """(records to send, records that this batch alone shows to be repeated)."""
    key = r.k64 ^ (r.k32.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    if not same.any():
        return r, r.take(np.zeros(0, int))
    tied = np.zeros(len(k), bool)
    tied[1:] |= same
    tied[:-1] |= same
    alone = np.sort(order[~tied])
    t = r.take(order[tied])
    t = t.take(np.lexsort((t.start, t.doc, t.k64, t.k32)))
    cls = np.ones(len(t.doc), bool)
    cls[1:] = (t.k32[1:] != t.k32[:-1]) | (t.k64[1:] != t.k64[:-1])
    rep = _repeated(t, cls, same_doc)
    send = Recs(*(np.concatenate(x) for x in zip(r.take(alone), t.take(~rep), strict=True)))
    return send.take(np.lexsort((send.start, send.doc))), t.take(rep)


def _emit(parts: list[Recs], keys: list[np.ndarray], n_keys: int, same_doc: bool) -> pa.RecordBatch:
    r = Recs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    key = np.concatenate(keys)
    # the route is a function of the class, so it can be carried through the combination by position
    r = r._replace(count=r.count.astype(np.int64) | (key.astype(np.int64) << 32))
    send, done = _combined(r, same_doc)
    key = (send.count >> 32).astype(np.int32)
    send = send._replace(count=(send.count & 0xFFFFFFFF).astype(np.int32))
    done = done._replace(count=(done.count & 0xFFFFFFFF).astype(np.int32))
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n_keys + 1))
    out = [(k, RECORDS, send.take(order[bounds[k] : bounds[k + 1]]).pack()) for k in np.flatnonzero(np.diff(bounds)).tolist()]
    if len(done.doc):
        out.append((int(cells(done.doc[:1], n_keys)[0]), FULL, done.pack()))  # the reduction deals them out
    return packed(out)


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["key", "kind", "blob"])


def cells(doc: np.ndarray, n: int) -> np.ndarray:
    return (kernel.mix(doc.astype(np.int64).view(U64)) % U64(n)).astype(np.int32)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Rows sorted by key, gathered one key at a time."""
    now, held = None, {}
    for b in batches:
        for k, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != now:
                if held:
                    yield now, held
                now, held = k, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def deal(df: DataFrame, n_partitions: int) -> DataFrame:
    """Keys are numbers from 0 on and go to partitions in turn: none is empty while another has several."""
    return df.repartitionById(n_partitions, F.pmod("key", F.lit(n_partitions))).sortWithinPartitions("key")


#: contexts gathered before a batch is combined and sent
BATCH = 1 << 19


def _first_round(rule: Rule, n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, held = [], [], 0
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(0)))
            ids, fps = b.column(0).to_numpy(), b.column(2).to_numpy()
            data, offs = kernel.buffers(b.column(1))
            for lo, hi in kernel.groups(offs):
                part = data[offs[lo] : offs[hi]]
                values, o = rule.symbols(part, offs[lo : hi + 1] - offs[lo])
                c = contexts(values, o, rule.length, rule.gram)
                if len(c.row):
                    key = (c.gram % U64(n_keys)).astype(np.int32)
                    parts.append(Recs((c.gram >> U64(32)).astype(np.uint32), c.whole, c.start.astype(np.int32), c.count.astype(np.int32), ids[lo:hi][c.row], fps[lo:hi][c.row]))
                    keys.append(key)
                    held += len(key)
                if held >= BATCH:
                    yield _emit(parts, keys, n_keys, rule.same_doc)
                    parts, keys, held = [], [], 0
        if held:
            yield _emit(parts, keys, n_keys, rule.same_doc)

    return run


def _reduce(rule: Rule, n_keys: int, expand: bool):
    """One key's records to marks, dealt by the document that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches):
            r, cls, group = _classes(Recs.unpack(held.get(RECORDS, [])))
            rep = _repeated(r, cls, rule.same_doc)
            out = [r.take(rep), Recs.unpack(held.get(FULL, []))]
            if expand and len(r.doc):
                g = np.cumsum(group) - 1
                branching = np.bincount(g, weights=cls)[g] > 1
                out.append(r.take(branching & ~rep))
            # k64 is of no more use but to say which marks are open
            x = Recs(*(np.concatenate(c) for c in zip(*(m._replace(k64=np.full(len(m.doc), k == 2, U64)) for k, m in enumerate(out)), strict=True)))
            if len(x.doc):
                cell = cells(x.doc, n_keys)
                order = np.lexsort((x.start, x.fp, x.doc, cell))
                x, cell = x.take(order), cell[order]
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                yield packed([(int(cell[a]), FULL, x.take(slice(a, b)).pack()) for a, b in zip(at, np.append(at[1:], len(cell)), strict=True)])

    return run


def _assemble(rule: Rule):
    """Marks of a cell's documents: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches):
            rows: dict[tuple[int, int], list] = {}
            every = Recs.unpack(held[FULL])
            for opened in (False, True):
                x = every.take((every.k64 == 1) == opened)
                x = x.take(np.lexsort((x.start, x.fp, x.doc)))
                if not len(x.doc):
                    continue
                at = np.flatnonzero(np.append(True, (x.doc[1:] != x.doc[:-1]) | (x.fp[1:] != x.fp[:-1])))
                for a, b in zip(at, np.append(at[1:], len(x.doc)), strict=True):
                    row = rows.setdefault((int(x.doc[a]), int(x.fp[a])), [None, None])
                    if not opened:
                        row[0] = merged(x.start[a:b], x.start[a:b] + (x.count[a:b] - 1 + rule.length)).tobytes()
                    else:
                        row[1] = np.stack([x.start[a:b], x.count[a:b], x.k32[a:b].view(np.int32)], 1).astype(np.int32).tobytes()
            if rows:
                ids, fps = zip(*rows, strict=True)
                full, opened = zip(*rows.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int32()), pa.array(full, pa.binary()), pa.array(opened, pa.binary())], names=["doc_id", "fp", "full", "open"])

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of ranges, sorted by their start, as an (n, 2) array; ranges that touch become one."""
    top = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > top[:-1])
    at = np.flatnonzero(new)
    return np.stack([lo[at], top[np.append(at[1:] - 1, len(lo) - 1)]], 1).astype(np.int32)


def first_round(docs: DataFrame, rule: Rule, n: int, n_keys: int) -> DataFrame:
    """Rows of MARKS: what is repeated for certain (full), and the contexts that may share windows with others (open)."""
    sent = docs.mapInArrow(_first_round(rule, n_keys), PACKED)
    met = deal(sent, n).mapInArrow(_reduce(rule, n_keys, True), PACKED)
    return cut(deal(met, n).mapInArrow(_assemble(rule), MARKS))


def covered(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, fp), with ``cover``: packed [lo, hi) ranges of symbols that repeated windows cover.

    ``fp`` tells rows of one doc_id but different texts apart; equal rows share their marks. ``marks``: doc_id, fp, full.
    """
    every = marks.groupBy("doc_id", "fp").agg(F.collect_list("full").alias("cover"))
    named = docs.where("doc_id is not null").join(every.hint("shuffle_hash"), ["doc_id", "fp"], "left").select("doc_id", "text", "cover")
    return named.unionByName(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("cover")))


def ranges(cover: list[bytes] | None) -> np.ndarray:
    """The ranges of a ``cover`` value, merged."""
    if not cover:
        return np.zeros((0, 2), np.int32)
    x = np.concatenate([np.frombuffer(b, np.int32) for b in cover]).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    return merged(x[:, 0], x[:, 1])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("fp"))
