"""Best-fit packing of token pieces into sequences, certified by lower bounds.

A document is its ids and an end mark. One of more than ``capacity`` tokens is cut into pieces of ``capacity``, the
first of which may be shorter. Pieces are dealt to partitions by a hash; each packs its own by best-fit decreasing.
Dual-feasible functions bound from below how many sequences a partition needs; one that meets its bound is certified
and gives up its loosest sequence alone, one with a gap gives up all sequences that aren't full. What is given up is
dealt anew to fewer partitions and packed again, until the bound over all pieces is met or a round gains nothing.

Very long texts are encoded whole. Null texts are empty: a single end mark. Repeated rows are packed each by itself; a null doc_id is kept as null.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import kernel
from marlstone.llm.session import cut, prepare, table

CAPACITY = 1024
END = 2
ROWS_PER_PARTITION = 200_000
ROUNDS = 6
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long, kept boolean, bins long, sure long, bound long"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(path: str, ranks: str | None, capacity: int, end: int, with_ids: bool):
    def run(batches):
        from marlstone.llm.tokens import Encoder

        enc = Encoder(path, ranks)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            _, offs = kernel.buffers(texts)
            for lo, hi in kernel.groups(offs, 1 << 19):
                got = enc.encode([t or "" for t in texts[lo:hi].to_pylist()])
                rows: list[list] = [[], [], [], [], [], []]
                for doc, x in zip(ids[lo:hi].to_pylist(), got, strict=True):
                    x = np.append(x, np.uint32(end)).astype("<u4")
                    n = len(x)
                    head = n % capacity or capacity
                    for k, a in enumerate([0, *range(head, n, capacity)]):
                        part = x[a : head + k * capacity].tobytes()
                        for col, v in zip(rows, (doc, k, a, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian uint32; null unless ``with_ids``).

    ``path``: a tokenizer's file, ``ranks``: its vocabulary as ranks, if there is one. Neither: the 50k byte-level BPE.
    """
    prepare(docs.sparkSession)
    if path is None:
        path, ranks = vocabulary(), vocabulary("byte_bpe_50k.tiktoken")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(path, ranks, capacity, end, with_ids), _PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that ``counts[s]`` pieces of each size s need at least; the capacity is ``len(counts) - 1``.

    The best of two families of dual-feasible functions: sizes under k are 0, over capacity-k are 1; and the
    rounding function ``floor((k+1) x / c) / k``, which keeps x/c where that product is whole.
    """
    c = len(counts) - 1
    size = np.arange(c + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    total = np.cumsum(n * size)
    many = np.cumsum(n)
    best = -(-int(total[-1]) // c)
    for k in range(1, c // 2 + 1):
        big = int(many[-1] - many[c - k])
        mid = int(total[c - k] - total[k - 1])
        best = max(best, big + -(-mid // c))
    for k in range(1, 41):
        up = (k + 1) * size
        u = np.where(up % c == 0, up * k // c, up // c * (k + 1))  # times k (k+1)
        best = max(best, -(-int((n * u).sum()) // (k * (k + 1))))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (sequence of each size, offset there, fill of each sequence)."""
    order = np.argsort(-sizes, kind="stable")
    seq, offs = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fill = 0, []
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        seq[i], offs[i] = b, fill[b]
        fill[b] += s
        r -= s
        if r:
            room[r].append(b)
            open_ |= 1 << r
    return seq, offs, np.array(fill, np.int64)


def _pack(capacity: int, turn: int, last: bool):
    def run(batches):
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        sizes = t.column("length").to_numpy().astype(np.int64)
        seq, offs, fill = best_fit(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1))
        kept = fill == capacity
        if len(fill) <= bound:
            kept[:] = True
            kept[np.argmin(fill)] = fill.min() == capacity
        if last:
            kept[:] = True
        base = (turn << 58) + (TaskContext.get().partitionId() << 34)
        flat = lambda x, kind: pa.chunked_array([pa.array(x, kind)])
        t = t.append_column("sequence_id", flat(seq + base, pa.int64())).append_column("offset", flat(offs, pa.int64())).append_column("kept", flat(kept[seq], pa.bool_()))
        for name, value in (("bins", len(fill)), ("sure", int(kept.sum())), ("bound", bound)):  # of the partition, in its first row
            one = np.zeros(len(sizes), np.int64)
            one[0] = value
            t = t.append_column(name, flat(one, pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset added. ``parts`` has the columns that ``pieces`` returns."""
    parts = cut(parts)
    names = parts.columns
    whole = parts.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out, pool = whole, parts.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pool.groupBy("length").count().collect():  # at most one row for each length
        counts[size] = n
    bound, rows, used, before = lower_bound(counts), int(counts.sum()), 0, None
    turn = 0
    while rows:
        turn += 1
        n = max(1, -(-rows // ROWS_PER_PARTITION))
        if turn > 1 and before == n:
            n = max(1, n // 2)
        last = turn == ROUNDS or (turn > 1 and n == 1)
        numbered = pool.withColumn("__n", F.monotonically_increasing_id())  # equal rows without a doc_id don't all meet
        numbered = numbered.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32", "__n", F.lit(turn))).drop("__n")
        done = cut(numbered.mapInArrow(_pack(capacity, turn, last), _PACKED))
        bins, sure, left = done.agg(F.sum("bins"), F.sum("sure"), F.sum((~F.col("kept")).cast("long"))).first()
        result = done.select(*names, "sequence_id", "offset")
        if used + bins <= bound or not left:
            return out.unionByName(result)
        out = out.unionByName(done.where("kept").select(*names, "sequence_id", "offset"))
        pool, rows, before = done.where("not kept").select(*names), int(left), n
        used += sure
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents", True), with_ids=False)).drop("ids")
