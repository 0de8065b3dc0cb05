"""Near-duplicates: b-bit MinHash signatures, a multi-index Hamming join, and confirmation on the full shingle sets.

A signature has CHUNKS * SLOTS minima of BITS bits. It is split into CHUNKS chunks; for each chunk and each of its
slots, the other slots make a key, so two chunks that differ in at most one slot share one. By pigeonhole every pair
whose signatures differ in at most 2 * CHUNKS - 1 slots shares a key. ``shape`` picks both numbers so that a pair at the
similarity asked for has no common key with a probability under 1e-6, and less above it.

Equal sets are one class from the start: a digest of 128 bits and the size group them. In a task, the first of a class leads
and the others are linked to it on the spot, so only leaders travel: a class of a third of all rows sends one row from
each task. The smallest leader of a class represents it; it alone is compared.

Documents that share keys form coarse clusters; those bound what has to be compared and decide nothing. Sets are compared
in full, by counting common shingles, in blocks, and only a spanning forest of the links leaves a task. A cluster of up to
BLOCK_DOCS representatives is one block. In a larger one, all are compared with a few pivots first; what that links to one
component need not be compared with itself any more, so only those outside the largest component are compared with all
others. So a large group of near copies costs a multiple of its size and not its square.

Definitions: null texts and texts without words have an empty set, are linked with nothing and form their own component.
Rows that share a doc_id are one node of the graph. A row without a doc_id is linked with nothing, its component_id is
null, and it is kept. Very long texts are read in slices. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm import graph, kernel
from marlstone.llm.kernel import U64, Prefix
from marlstone.llm.repeats import PACKED, by_key, deal, packed
from marlstone.llm.session import cut, drop, keys, partitions, table

WORDS = 5
PERCENT = 85
BITS = 16


def shape(percent: int, missed: float = 1e-6, most: int = 128) -> tuple[int, int]:
    """(chunks, slots): the widest chunks, up to 8 slots, with which that share of pairs at the similarity is missed at most."""
    p = min(percent / 100, 0.999)
    for slots in range(8, 0, -1):
        meets = p**slots + slots * (1 - p) * p ** (slots - 1)
        chunks = max(2, math.ceil(math.log(missed) / math.log(1 - meets))) if meets < 1 else 2
        if chunks * slots <= most or slots == 1:
            return chunks, slots
    raise AssertionError


CHUNKS, SLOTS = shape(PERCENT)
#: classes that a task remembers the leader of; beyond it, it begins anew and a class has another leader
LEADERS = 200_000
#: rows of a table that is broadcast, after they were counted
BROADCAST_ROWS = 200_000
#: what one side of a block comparison holds at most, about
BLOCK_DOCS, BLOCK_SHINGLES = 256, 2_000_000
PIVOTS = 4
_R = np.random.default_rng(77).integers(0, 1 << 32, (2, 512), dtype=np.uint32)
_SETS = "doc_id long, n_shingles long, d1 long, d2 long, lead long, keys binary"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles with repeats, n+1 offsets) of texts laid end to end."""
    data = kernel.lower_ascii(data)
    w = kernel.words(data, offsets)
    h = kernel.word_hashes(data, w)
    n = np.diff(w.first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    lo = kernel.spans(w.first[:-1], count)
    hi = lo + np.minimum(words, np.repeat(n, count))
    out = np.empty(len(lo), U64)
    for a in range(0, len(lo), kernel.GROUP):  # in slices, for long texts
        z = min(a + kernel.GROUP, len(lo))
        base, top = lo[a], hi[z - 1]
        out[a:z] = Prefix(h[base:top]).at(lo[a:z] - base, hi[a:z] - base)
    return out, out_at


def unique_sets(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set sorted, without repeats."""
    x = x.copy()
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x[a:z].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[at[:-1][at[:-1] < len(x)]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], sums[at]


def signatures(x: np.ndarray, at: np.ndarray, size: int = CHUNKS * SLOTS) -> np.ndarray:
    """Minima of sets that aren't empty: a row for each, BITS bits in each slot."""
    v = (x >> U64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, size), np.uint16)
    for j in range(size):
        out[:, j] = np.minimum.reduceat((v ^ _R[0, j]) * (_R[1, j] | np.uint32(1)), at[:-1]) >> np.uint32(32 - BITS)
    return out


def chunk_keys(sig: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """All keys of each signature, one for each slot, of 64 bits."""
    slot = np.arange(sig.shape[1], dtype=U64)
    h = kernel.mix(sig.astype(U64) + (slot + U64(1)) * U64(0x9E3779B97F4A7C15)).reshape(len(sig), -1, slots)
    return kernel.mix(h.sum(2, keepdims=True, dtype=U64) - h + slot.reshape(-1, slots)).reshape(len(sig), -1)


def _describe(chunks: int, slots: int):
    """Rows of ``_SETS``. Leaders alone (lead = doc_id, first row of their class in the task) have keys."""

    def run(batches):
        leads: dict[tuple[int, int, int], int] = {}
        for b in batches:
            ids = b.column(0)
            data, offs = kernel.buffers(b.column(1))
            for lo, hi in kernel.groups(offs):
                x, at = unique_sets(*shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                n = np.diff(at)
                some = np.flatnonzero(n)
                d = np.zeros((2, hi - lo), U64)
                keys: list[bytes | None] = [None] * (hi - lo)
                lead: list[int | None] = [None] * (hi - lo)
                if len(some):
                    starts = at[:-1][some]
                    d[0, some] = np.add.reduceat(kernel.mix(x), starts)
                    d[1, some] = np.add.reduceat(kernel.mix(x ^ U64(0x5851F42D4C957F2D)), starts)
                    if len(leads) > LEADERS:
                        leads.clear()
                    doc, chosen = ids[lo:hi].to_pylist(), []
                    for i in some.tolist():
                        if doc[i] is not None:
                            k = (int(d[0, i]), int(d[1, i]), int(n[i]))
                            if k not in leads:
                                leads[k] = doc[i]
                                chosen.append(i)
                            lead[i] = leads[k]
                    if chosen:
                        pick = np.array(chosen, np.int64)
                        sub = x[kernel.spans(at[:-1][pick], n[pick])]
                        got = chunk_keys(signatures(sub, np.concatenate([[0], np.cumsum(n[pick])]), chunks * slots), slots)
                        for i, k in zip(chosen, got, strict=True):
                            keys[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(n, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(lead, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "lead", "keys"])

    return run


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (key, smallest doc) and edges from each key's other docs to that one."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(new)
    low = doc[at][np.cumsum(new) - 1]
    other = doc != low
    return key[at], doc[at], doc[other], low[other]


def _deal_keys(n_keys: int):
    def send(parts):
        key = np.concatenate([np.frombuffer(k, U64) for k, _ in parts])
        doc = np.repeat(np.array([d for _, d in parts], np.int64), len(key) // len(parts))
        key, doc, a, b = _stars(key, doc)
        cell = (key % U64(n_keys)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[order], np.arange(n_keys + 1))
        rows = [(k, 0, key[o].tobytes() + doc[o].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist() if len(o := order[cuts[k] : cuts[k + 1]])]
        if len(a):
            a, b = graph.forest(a, b)
            rows.append((int(a[0] % n_keys), 1, a.tobytes() + b.tobytes()))
        return packed(rows)

    def run(batches):
        parts = []
        for b in batches:
            for k, d in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                parts.append((k, d))
                if len(parts) * len(k) >= 1 << 23:
                    yield send(parts)
                    parts = []
        if parts:
            yield send(parts)

    return run


def _halves(blobs: list[bytes], dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.frombuffer(x, dtype, len(x) // 16), np.frombuffer(x, np.int64, offset=len(x) // 2)) for x in blobs]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype), np.zeros(0, np.int64))


def _meet(n_keys: int):
    """Edges between documents that share a key, dealt so that the same edge from other keys comes to the same place."""

    def run(batches):
        for _, held in by_key(batches):
            _, _, a, b = _stars(*_halves(held[0], U64)) if 0 in held else (None, None, np.zeros(0, np.int64), np.zeros(0, np.int64))
            c, d = _halves(held.get(1, []), np.int64)
            a, b = np.concatenate([a, c]), np.concatenate([b, d])
            if not len(a):
                continue
            a, b = graph.forest(a, b)
            cell = (kernel.mix(kernel.mix(a.view(U64)) ^ b.view(U64)) % U64(n_keys)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cuts = np.searchsorted(cell[order], np.arange(n_keys + 1))
            yield packed([(k, 0, a[o].tobytes() + b[o].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist() if len(o := order[cuts[k] : cuts[k + 1]])])

    return run


def _once(batches):
    """Edges of a cell, each once."""
    for _, held in by_key(batches):
        yield graph.edge_batch(*np.unique(np.stack(_halves(held[0], np.int64)), axis=1))


def common_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between two lists of sets (or within one), as a matrix.

    Frequent shingles are counted by products of 0/1 matrices, a slice of columns at a time; rare ones pair by pair.
    """
    x, at = left
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n_left = len(at) - 1
    if right is not None:
        x = np.concatenate([x, right[0]])
        rows = np.concatenate([rows, np.repeat(np.arange(len(right[1]) - 1), np.diff(right[1])) + n_left])
    n = n_left + (len(right[1]) - 1 if right is not None else 0)
    order = np.argsort(x, kind="stable")
    x, rows = x[order], rows[order]
    new = np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(x)))
    a, b = (n_left, n - n_left) if right is not None else (n, n)
    out = np.zeros((a, b), np.float32)
    shift = n_left if right is not None else 0
    often = np.flatnonzero(size > 24)
    for lo in range(0, len(often), 1024):
        cols = often[lo : lo + 1024]
        m = np.zeros((n, len(cols)), np.float32)
        m[rows[kernel.spans(start[cols], size[cols])], np.repeat(np.arange(len(cols)), size[cols])] = 1
        out += m[:a] @ m[shift:].T
    flat = out.ravel()
    for c in range(2, 25):
        at_c = start[size == c]
        if len(at_c):
            r = rows[at_c[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(c):
                    if i != j:
                        p, q = r[:, i], r[:, j] - shift
                        ok = (p < a) & (q >= 0) & (q < b)
                        np.add.at(flat, p[ok] * b + q[ok], np.float32(1))
    return out


def linked(common: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    c = common.astype(np.int64)
    return 100 * c >= percent * (left[:, None] + right[None, :] - c)


def _confirm(percent: int):
    """Groups (rows of equal root, i, j; a document's side is 0 or 1) to a spanning forest of their links."""

    def compare(rows):
        sides = []
        for side in (0, 1):
            mine = [r for r in rows if r[1] == side]
            raw = b"".join(r[2] for r in mine)
            offs = np.concatenate([[0], np.cumsum([len(r[2]) for r in mine])]).astype(np.int64)
            sides.append((np.array([r[0] for r in mine], np.int64), unique_sets(*shingles(np.frombuffer(raw, np.uint8), offs)) if mine else None))
        (doc_l, left), (doc_r, right) = sides
        if left is None or (right is None and len(doc_l) < 2):
            return None
        n_l = np.diff(left[1])
        n_r, doc_r = (np.diff(right[1]), doc_r) if right is not None else (n_l, doc_l)
        p, q = np.nonzero(linked(common_counts(left, right), n_l, n_r, percent))
        a, b = doc_l[p], doc_r[q]
        other = a != b
        return graph.forest(a[other], b[other]) if other.any() else None

    def run(batches):
        now, rows = None, []
        for b in batches:
            b = b.to_pydict()
            for root, i, j, side, doc, text in zip(b["root"], b["i"], b["j"], b["side"], b["doc_id"], b["text"], strict=True):
                if (root, i, j) != now:
                    if (got := compare(rows)) is not None:
                        yield graph.edge_batch(*got)
                    now, rows = (root, i, j), []
                rows.append((doc, side, (text or "").encode()))
        if (got := compare(rows)) is not None:
            yield graph.edge_batch(*got)

    return run


def _compared(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the sides of each group (root, i, j), or within side 0 if there is no other."""
    return rows.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_confirm(percent), graph.EDGES)


def _by_root(df: DataFrame, per_root: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` with what is known of its clusters; a hot cluster's rows stay where they are if that is little."""
    per_root = cut(per_root)
    return df.join(F.broadcast(per_root) if per_root.count() <= BROADCAST_ROWS else per_root, "root", how)


def _large(texts: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Links in clusters of more than one block. ``texts``: root, blocks, doc_id, text; ``placed``: the same without texts."""
    block = lambda: F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pivots = placed.groupBy("root").agg(*(F.min_by("doc_id", F.xxhash64(F.lit(k), "doc_id")).alias(f"p{k}") for k in range(PIVOTS)))
    pivots = pivots.select("root", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("doc_id"))
    chosen = texts.join(cut(pivots), ["root", "doc_id"]).select("root", every().alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "doc_id", "text")
    members = texts.select("root", block().alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "doc_id", "text")
    first = cut(_compared(chosen.unionByName(members), n, percent))
    labels = graph.components(first)
    labels = placed.select("root", "doc_id").join(labels.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "label"), "doc_id", "left").select("root", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    labels = cut(labels)
    sizes = labels.groupBy("root", "label").count()
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("docs"), F.max("count").alias("settled"))
    main = main.where("docs > settled").select("root", "main", F.ceil((F.col("docs") - F.col("settled")) / BLOCK_DOCS).cast("int").alias("parts"))
    rows = _by_root(texts, main)
    opened = _by_root(labels, main).where("label <> main").select("root", "doc_id")
    part = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.col("parts")).cast("int")
    left = rows.select("root", block().alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(0).alias("side"), "doc_id", "text")
    right = rows.join(opened, ["root", "doc_id"]).select("root", every().alias("i"), part.alias("j"), F.lit(1).alias("side"), "doc_id", "text")
    return first.unionByName(_compared(left.unionByName(right), n, percent))


def links(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, n_keys = partitions(docs), keys(docs)
    sets = cut(docs.mapInArrow(_describe(*shape(percent)), _SETS))
    known = sets.where("lead is not null")
    local = known.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    leaders = known.where("keys is not null").select("doc_id", "n_shingles", "d1", "d2")
    least = leaders.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b < top").drop("top")
    same = cut(leaders.join(least, ["d1", "d2", "n_shingles"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    keyed = sets.where("keys is not null").select("doc_id", "keys")
    edges = deal(keyed.mapInArrow(_deal_keys(n_keys), PACKED), n).mapInArrow(_meet(n_keys), PACKED)
    coarse = graph.components(deal(edges, n).mapInArrow(_once, graph.EDGES).unionByName(same))
    members = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())
    sizes = leaders.select(F.col("doc_id").alias("node"), "n_shingles").join(members, "node").join(same.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    sizes = cut(sizes)
    blocks = sizes.groupBy("root").agg(F.count("*").alias("docs"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = cut(blocks.where("docs > 1 or blocks > 1").drop("docs"))
    # clusters of one representative have nothing to compare; where few are left, no row has to travel to learn its cluster's blocks
    few = blocks.count() <= BROADCAST_ROWS
    placed = cut(sizes.join(F.broadcast(blocks) if few else blocks, "root").select(F.col("node").alias("doc_id"), "root", "blocks").distinct())
    texts = cut(docs.where("doc_id is not null").join(placed.hint("shuffle_hash"), "doc_id").select("root", "blocks", "doc_id", "text"))
    small = texts.where("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "doc_id", "text")
    close = _compared(small, n, percent)
    if blocks.where("blocks > 1").limit(1).count():
        close = close.unionByName(_large(texts.where("blocks > 1"), placed.where("blocks > 1"), n, percent))
    roots = graph.components(close.unionByName(same).unionByName(local))
    drop(texts, placed, blocks, sizes, same)
    numbered = sets.where("doc_id is not null").select("doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id").hint("shuffle_hash"), "doc_id", "left")
    out = numbered.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), (F.col("root").isNull() | (F.col("root") == F.col("doc_id"))).alias("kept"))
    unnumbered = sets.where("doc_id is null")  # apart, so that they don't all meet in the join
    return out.unionByName(unnumbered.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id. All columns are returned.

    Rows that share doc_id and text are one document: the row stays whose other columns, as JSON, come first. Rows that share a
    doc_id alone are different texts and stay or go together. Rows without a doc_id all stay.
    """
    gone = links(docs, percent).where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    rest = named.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        row = F.struct(*others)
        rest = rest.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("doc_id", "text", "__row.*")
    else:
        rest = rest.distinct()
    return rest.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op8(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents", True))
