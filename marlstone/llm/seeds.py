"""Which stretches of texts can repeat at all: a filter that spares later stages everything that is unique.

A window of ``length`` symbols has an anchor (see ``contexts``); equal windows have equal anchors. A context, a run of windows
with one anchor, is open if its anchor's symbols are the anchor of another context, too. Windows of contexts that aren't
open occur once. Anchors travel packed; those that repeat within a batch are known at once, and one of them travels for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm import kernel
from marlstone.llm.contexts import contexts
from marlstone.llm.kernel import U64
from marlstone.llm.repeats import FULL, RECORDS, Recs, by_key, cells, deal, packed
from marlstone.llm.session import keys, partitions

PACKED = "key int, kind int, blob binary"
BATCH = 1 << 19


def _tied(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose value occurs more than once, one place for each value)."""
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    tied = np.zeros(len(s), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.sort(order[tied]), np.sort(order[np.append(True, ~same)]) if len(s) else order


def _send(symbols, length: int, gram: int, n_keys: int):
    def emit(parts: list[Recs]):
        r = Recs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        again, one = _tied(r.k64)
        send, key = r.take(one), (r.k64[one] % U64(n_keys)).astype(np.int32)
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], np.arange(n_keys + 1))
        rows = [(k, RECORDS, send.take(order[cuts[k] : cuts[k + 1]]).pack()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        if len(again):
            done = r.take(again)
            rows.append((int(cells(done.doc[:1], n_keys)[0]), FULL, done.pack()))  # the reduction deals them out
        return packed(rows)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            ids, fps = b.column(0).to_numpy(), b.column(2).to_numpy()
            data, offs = kernel.buffers(b.column(1))
            for lo, hi in kernel.groups(offs):
                values, o = symbols(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                c = contexts(values, o, length, gram)
                if len(c.row):
                    parts.append(Recs(np.zeros(len(c.row), np.uint32), c.gram, c.start.astype(np.int32), c.count.astype(np.int32), ids[lo:hi][c.row], fps[lo:hi][c.row]))
                    held += len(c.row)
                if held >= BATCH:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return run


def _meet(n_keys: int):
    def run(batches):
        for _, held in by_key(batches):
            r = Recs.unpack(held.get(RECORDS, []))
            r = r.take(_tied(r.k64)[0])
            done = Recs.unpack(held.get(FULL, []))
            r = Recs(*(np.concatenate(x) for x in zip(r, done, strict=True)))
            if len(r.doc):
                r = r._replace(k64=np.zeros(len(r.doc), U64))
                cell = cells(r.doc, n_keys)
                order = np.lexsort((r.start, r.fp, r.doc, cell))
                r, cell = r.take(order), cell[order]
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                yield packed([(int(cell[a]), FULL, r.take(slice(a, b)).pack()) for a, b in zip(at, np.append(at[1:], len(cell)), strict=True)])

    return run


def _assemble(batches):
    for _, held in by_key(batches):
        r = Recs.unpack(held[FULL])
        r = r.take(np.lexsort((r.start, r.fp, r.doc)))
        keep = np.ones(len(r.doc), bool)
        keep[1:] = (r.doc[1:] != r.doc[:-1]) | (r.fp[1:] != r.fp[:-1]) | (r.start[1:] != r.start[:-1])
        r = r.take(keep)
        at = np.flatnonzero(np.append(True, (r.doc[1:] != r.doc[:-1]) | (r.fp[1:] != r.fp[:-1])))
        opened = [np.stack([r.start[a:b], r.count[a:b]], 1).astype(np.int32).tobytes() for a, b in zip(at, np.append(at[1:], len(r.doc)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(r.doc[at]), pa.array(r.fp[at]), pa.array(opened, pa.binary())], names=["doc_id", "fp", "open"])


def opened(docs: DataFrame, symbols, length: int, gram: int) -> DataFrame:
    """doc_id, fp, open: packed (start, windows) of the open contexts of ``docs`` (doc_id, text, fp; no null doc_id)."""
    n, n_keys = partitions(docs), keys(docs)
    sent = deal(docs.mapInArrow(_send(symbols, length, gram, n_keys), PACKED), n)
    return deal(sent.mapInArrow(_meet(n_keys), PACKED), n).mapInArrow(_assemble, "doc_id long, fp int, open binary")
