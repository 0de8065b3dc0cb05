"""Substring deduplication over bytes by a sampled, range-partitioned suffix array.

A filter comes first (``repeats``): strings of ``length`` bytes whose anchor occurs once cannot repeat, and whole contexts that
are equal are settled there, by hashes of 96 bits. The strings of all other contexts are suffixes to be sorted. Every such
string has an anchor, at a place that its content decides; splitters sampled from the leading bytes of the suffixes at
these anchors range-partition the contexts, which travel with their bytes. In a bucket, all suffixes that begin a string
are sorted by multikey quicksort, eight bytes at a time, only what is tied going on to the next eight; neighbours with
a common prefix of ``length`` bytes are one class, and of a class the strings of all but the smallest doc_id go. Equal
strings lie in one bucket unless a boundary cuts through the suffixes that begin with their bytes from the anchor on: such
strings, as far as their bucket left them, are compared across boundaries byte by byte.

Nulls are empty texts: no bytes, nothing removed, the hash of an empty text. Rows without a doc_id are returned
unreduced and don't count as earlier. Equal doc_ids never match each other, so repeated rows are reduced alike. Very long texts
are read in slices. An empty table gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import kernel, repeats
from marlstone.llm.kernel import U64, Prefix, mix
from marlstone.llm.repeats import FULL, PACKED, RECORDS, Recs, by_key, cells, deal, packed
from marlstone.llm.session import cut, keys, partitions

BYTES = 50
GRAM = 20
#: leading bytes of a splitter
LEAD = 32
#: documents sampled for splitters at most; the sample decides balance only, never results
SAMPLE_DOCS = 2000
#: contexts that a sender handles at once
RUNS = 1 << 14
BOUND = 2
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def anchored(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int, gram: int):
    """Bytes of contexts laid end to end, where each begins there, its anchor's place in it, and its leading bytes from the anchor on."""
    size = count + length - 1
    text = data[kernel.spans(start, size)]
    base = np.concatenate([[0], np.cumsum(size)])
    p = Prefix(kernel._T[text])
    at = base[:-1, None] + np.arange(length - gram + 1)
    anchor = (mix(p.raw(at, at + gram)) >> U64(32)).argmin(1)
    wide = np.concatenate([text, np.zeros(LEAD, np.uint8)])
    lead = np.lib.stride_tricks.sliding_window_view(wide, LEAD)[base[:-1] + anchor].copy()
    lead[np.arange(LEAD) >= (size - anchor)[:, None]] = 0  # what lies beyond the context says nothing about its strings
    return text, base, anchor, lead.view(f"S{LEAD}").ravel()


def _runs(b: pa.RecordBatch):
    """(bytes, ids, fps, row, start, count) of open contexts, in slices. Columns: doc_id, text, fp, open."""
    ids, fps = b.column(0).to_numpy(), b.column(2).to_numpy()
    data, offs = kernel.buffers(b.column(1))
    mine = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in b.column(3).to_pylist()]
    runs = np.concatenate(mine).astype(np.int64) if mine else np.zeros((0, 3), np.int64)
    row = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
    for lo in range(0, len(runs), RUNS):
        part, r = runs[lo : lo + RUNS], row[lo : lo + RUNS]
        yield data, ids[r], fps[r], part[:, 0], offs[r] + part[:, 0], part[:, 1]


def splitters(rows: DataFrame, n: int, length: int, gram: int) -> np.ndarray:
    """n-1 quantiles of the leading bytes of the anchors' suffixes in ``rows`` (doc_id, text, fp, open)."""

    def run(batches):
        for b in batches:
            for data, _, _, _, at, count in _runs(b):
                lead = np.sort(anchored(data, at, count, length, gram)[3])
                yield pa.RecordBatch.from_arrays([pa.array([lead[:: max(1, len(lead) // 1024)].tobytes()], pa.binary())], names=["lead"])

    got = [np.frombuffer(r.lead, f"S{LEAD}") for r in rows.mapInArrow(run, "lead binary").collect()]
    lead = np.sort(np.concatenate([np.zeros(0, f"S{LEAD}"), *got]))
    return lead[(np.arange(1, n) * len(lead)) // n] if len(lead) else lead


def _send(split: np.ndarray, n: int, length: int, gram: int):
    """Open contexts to their buckets, with their bytes."""

    def run(batches):
        for b in batches:
            for data, doc, fp, start, at, count in _runs(b):
                text, base, anchor, lead = anchored(data, at, count, length, gram)
                bucket = np.searchsorted(split, lead, "right")
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    o = order[cuts[k] : cuts[k + 1]]
                    cols = (np.array([len(o)], np.int64), doc[o], fp[o].astype(np.int32), start[o].astype(np.int32), count[o].astype(np.int32), anchor[o].astype(np.int32))
                    rows.append((k, RECORDS, b"".join(c.tobytes() for c in cols) + text[kernel.spans(base[o], base[o + 1] - base[o])].tobytes()))
                yield packed(rows)

    return run


def _unpacked(blobs: list[bytes]):
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for b in blobs:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for c, kind in zip(cols, (np.int64, np.int32, np.int32, np.int32, np.int32), strict=False):
            c.append(np.frombuffer(b, kind, n, at))
            at += n * np.dtype(kind).itemsize
        cols[5].append(np.frombuffer(b, np.uint8, offset=at))
    return tuple(np.concatenate(c) for c in cols)


def multikey(text: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at ``pos`` by their first ``length`` bytes, marks of those that differ there from the one before).

    A symbol is eight bytes, read as one number. Each round sorts the suffixes that all symbols so far leave tied, within
    their ties.
    """
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(wide, 8)

    def symbol(at: np.ndarray, depth: int) -> np.ndarray:
        x = eight[at + depth].copy().view(">u8").ravel().astype(U64)
        return x if depth + 8 <= length else x >> U64(8 * (depth + 8 - length))

    s = symbol(pos, 0)
    order = np.argsort(s, kind="stable")
    s = s[order]
    new = np.ones(len(pos), bool)
    new[1:] = s[1:] != s[:-1]
    for depth in range(8, length, 8):
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        s = symbol(pos[order[tied]], depth)
        by = np.lexsort((s, group))
        order[tied], s, group = order[tied][by], s[by], group[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (group[1:] != group[:-1])
        new[tied] = fresh
    return order, new


def _array(split: np.ndarray, n: int, length: int):
    """A bucket's suffix array to marks (dealt by document) and to the strings that a boundary may part from equal ones."""

    def run(batches):
        for key, held in by_key(batches):
            doc, fp, start, count, anchor, text = _unpacked(held[RECORDS])
            base = np.concatenate([[0], np.cumsum(count.astype(np.int64) + length - 1)])[:-1]
            pos = kernel.spans(base, count)
            of = np.repeat(np.arange(len(doc)), count)
            shift = pos - base[of]
            order, new = multikey(text, pos, length)
            first = np.flatnonzero(new)
            low = np.minimum.reduceat(doc[of[order]], first)
            least = np.repeat(low, np.diff(np.append(first, len(order))))
            gone = doc[of[order]] > least
            hit = order[gone]
            if len(hit):
                r = Recs(np.zeros(len(hit), np.uint32), np.zeros(len(hit), U64), (start[of[hit]] + shift[hit]).astype(np.int32), np.ones(len(hit), np.int32), doc[of[hit]], fp[of[hit]])
                cell = cells(r.doc, n)
                by = np.lexsort((r.start, r.fp, r.doc, cell))
                r, cell = r.take(by), cell[by]
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                yield packed([(int(cell[a]), FULL, r.take(slice(a, z)).pack()) for a, z in zip(at, np.append(at[1:], len(cell)), strict=True)])
            left = np.sort(order[~gone])
            known = length - anchor[of[left]] + shift[left]  # bytes from the anchor to the string's end
            left, known = left[known < LEAD], known[known < LEAD]
            for edge in (key - 1, key):
                if not 0 <= edge < len(split) or not len(left):
                    continue
                cut_ = np.frombuffer(split[edge].ljust(LEAD, b"\0"), np.uint8)
                head = text[np.minimum((base + anchor)[of[left]][:, None] + np.arange(LEAD), len(text) - 1)] == cut_
                near = left[np.where(head.all(1), LEAD, head.argmin(1)) >= known]
                if len(near):
                    strings = text[pos[near][:, None] + np.arange(length)].tobytes()
                    cols = (np.array([len(near)], np.int64), doc[of[near]], fp[of[near]].astype(np.int32), (start[of[near]] + shift[near]).astype(np.int32))
                    yield packed([(key, BOUND, b"".join(c.tobytes() for c in cols) + strings)])

    return run


def _strings(length: int):
    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                n = int(np.frombuffer(x, np.int64, 1)[0])
                doc, fp, start = np.frombuffer(x, np.int64, n, 8), np.frombuffer(x, np.int32, n, 8 + 8 * n), np.frombuffer(x, np.int32, n, 8 + 12 * n)
                raw = x[8 + 16 * n :]
                full = np.stack([start, start + length], 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(fp), pa.array([raw[k * length : (k + 1) * length] for k in range(n)], pa.binary()), pa.array([f.tobytes() for f in full], pa.binary())],
                    names=["doc_id", "fp", "string", "full"])

    return run


def _keep(with_bytes: bool):
    def run(batches):
        for b in batches:
            ids, covers = b.column(0), b.column(2).to_pylist()
            n_bytes, n_removed, n_spans, kept, sha = [], [], [], [], []
            data, offs = kernel.buffers(b.column(1))
            view = memoryview(np.ascontiguousarray(data))
            for i, cover in enumerate(covers):
                lo, hi = int(offs[i]), int(offs[i + 1])
                gone = repeats.ranges(cover)
                h = hashlib.sha256()
                at, parts = lo, []
                for a, z in gone.tolist():
                    parts.append(view[at : lo + a])
                    at = lo + z
                parts.append(view[at:hi])
                for p in parts:
                    h.update(p)
                n_bytes.append(hi - lo)
                n_removed.append(int((gone[:, 1] - gone[:, 0]).sum()))
                n_spans.append(len(gone))
                sha.append(h.hexdigest())
                kept.append(b"".join(parts) if with_bytes else None)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def _repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text, cover of each row of ``docs`` (doc_id, text, fp)."""
    n, n_keys = partitions(docs), keys(docs)
    rule = repeats.Rule(length, gram, repeats.of_bytes, False)
    first = repeats.first_round(docs, rule, n, n_keys)
    opened = first.where("open is not null").select("doc_id", "fp", "open")
    key = ["doc_id", "fp"]
    rows = docs.join(opened.hint("shuffle_hash"), key).select("doc_id", "text", "fp", "open")
    every = max(1, opened.count() // SAMPLE_DOCS)
    some = opened.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(2 * SAMPLE_DOCS)
    split = splitters(docs.join(F.broadcast(some), key).select("doc_id", "text", "fp", "open"), n_keys, length, gram)
    found = cut(deal(rows.mapInArrow(_send(split, n_keys, length, gram), PACKED), n).mapInArrow(_array(split, n_keys, length), PACKED))
    again = cut(deal(found.where(F.col("kind") == FULL), n).mapInArrow(repeats._assemble(rule), repeats.MARKS))
    parted = found.where(F.col("kind") == BOUND).select("blob").mapInArrow(_strings(length), "doc_id long, fp int, string binary, full binary")
    low = parted.groupBy("string").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("string", "low")
    late = parted.join(low, "string").where("doc_id > low").select("doc_id", "fp", "full")
    marks = first.where("full is not null").select("doc_id", "fp", "full").unionByName(again.select("doc_id", "fp", "full")).unionByName(late)
    return repeats.covered(docs, marks)


def dedup_bytes(docs: DataFrame, length: int = BYTES, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (null unless ``with_bytes``), kept_sha256.
    """
    return _repeated(repeats.with_fingerprint(docs), length, min(gram, length)).mapInArrow(_keep(with_bytes), _OUT)


def op6(spark, sf_dir: str) -> DataFrame:
    from marlstone.llm.session import table

    return dedup_bytes(table(spark, sf_dir, "documents", True), with_bytes=False).drop("kept")
