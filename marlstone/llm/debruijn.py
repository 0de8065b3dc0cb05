"""Substring deduplication over words by compaction of the de Bruijn graph.

Nodes are stretches of ``length - 1`` words, edges the windows of ``length`` words that join two of them. A filter (``seeds``)
first leaves out windows that cannot occur twice. The others become a table of edges, hashed and bucketed by content, with
where they occur and which words come before and after. A groupBy finds the repeated edges, their first occurrence, and
whether all their occurrences go on, and come from, the same way. Where one edge always goes on to the next and that always
comes from the first, there is no branch: joins on the coordinates of first occurrences link such edges, and linked edges
are compacted to paths. All edges of a path occur together, so only the occurrences of its head are looked up, by a join
that the buckets spare a shuffle. At these source coordinates the words themselves are read: occurrences of a path whose
words have one digest of 128 bits are the same span, the first of them stays, the others are removed.

Nulls and texts without words have no windows and come back with n_words 0 and the hash of an empty text. Rows without
a doc_id are returned as they are, neither reduced nor counted as earlier. Equal rows are one document: they are reduced
alike. Rows with one doc_id and different texts are apart; their windows are ordered by start. Very long texts are read in
slices. An empty table gives an empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from marlstone.llm import kernel, repeats, seeds
from marlstone.llm.kernel import U64, Prefix
from marlstone.llm.session import cut, drop, folder, partitions, tidy

WORDS = 20
GRAM = 12
#: windows that are combined before they travel
BATCH = 1 << 18
#: a path with more occurrences is hot: it is broadcast to them, if such paths are few
HOT, BROADCAST_ROWS = 1000, 200_000
#: buckets of the table of edges at most
BUCKETS = 100_000
_OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_EDGES = "h long, doc long, at long, before int, after int, n int, others binary"


def _hashes(values: np.ndarray, at: np.ndarray, length: int, alone: bool) -> np.ndarray:
    """Hashes of the windows that start at ``at``; one long text is taken in slices."""
    if not alone or len(values) <= 2 * kernel.GROUP:
        return Prefix(values).at(at, at + length)
    out = np.empty(len(at), U64)
    for a in range(0, len(values), kernel.GROUP):
        here = (at >= a) & (at < a + kernel.GROUP)
        if here.any():
            out[here] = Prefix(values[a : a + kernel.GROUP + length]).at(at[here] - a, at[here] - a + length)
    return out


def _edges(length: int):
    """Open windows to rows of ``_EDGES``, one for each content in a batch: its first occurrence (at: start and fp in one number),
    the words beside it (0: none, or not always the same), how many there are, and where the others lie."""

    def emit(parts):
        h, doc, at, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, h))
        h, doc, at, before, after = h[order], doc[order], at[order], before[order], after[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        sides = []
        for x in (before, after):
            low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            sides.append(np.where(low == high, low, 0))
        others: list[bytes | None] = [None] * len(first)
        for k in np.flatnonzero(n > 1).tolist():
            a, z = first[k] + 1, first[k] + n[k]
            others[k] = doc[a:z].tobytes() + at[a:z].tobytes()
        # rows leave in the order of their documents, so that what neighbours share is written once by the shuffle's compression
        place = np.lexsort((at[first], doc[first]))
        others = [others[k] for k in place.tolist()]
        cols = [c[place] for c in (h[first].view(np.int64), doc[first], at[first], *sides, n.astype(np.int32))]
        names = ["h", "doc", "at", "before", "after", "n", "others"]
        for lo in range(0, len(first), 1 << 14):
            z = slice(lo, lo + (1 << 14))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[z]) for c in cols), pa.array(others[z], pa.binary())], names=names)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            ids, fps = b.column(0).to_numpy(), b.column(2).to_numpy()
            data, offs = kernel.buffers(b.column(1))
            opens = b.column(3).to_pylist()
            for lo, hi in kernel.groups(offs):
                values, o = repeats.of_words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                mine = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in opens[lo:hi]]
                runs = np.concatenate(mine).astype(np.int64)
                row = np.repeat(np.repeat(np.arange(hi - lo), [len(x) for x in mine]), runs[:, 1])
                start = kernel.spans(runs[:, 0], runs[:, 1])
                place = start + o[row]
                word = (values >> U64(33)).astype(np.int32) | 1  # never 0
                before = np.where(start > 0, word[np.maximum(place - 1, 0)], 0)
                end = place + length
                after = np.where(end < o[row + 1], word[np.minimum(end, len(word) - 1)], 0)
                h = _hashes(values, place, length, hi - lo == 1)
                parts.append((h, ids[lo:hi][row], (start << 32) | fps[lo:hi][row].view(np.uint32).astype(np.int64), before.astype(np.int32), after.astype(np.int32)))
                held += len(h)
                if held >= BATCH:
                    yield from emit(parts)
                    parts, held = [], 0
        if held:
            yield from emit(parts)

    return run


def _occurrences(batches):
    """Rows (path, size, doc, at, others) to a row for each occurrence."""
    for b in batches:
        path, size, doc, at = (b.column(k).to_numpy() for k in range(4))
        parts = [(path, size, doc, at)]
        for k, x in enumerate(b.column(4).to_pylist()):
            if x:
                m = len(x) // 16
                parts.append((np.full(m, path[k]), np.full(m, size[k]), np.frombuffer(x, np.int64, m), np.frombuffer(x, np.int64, m, 8 * m)))
        path, size, doc, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        cols = [doc, (at & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (at >> 32).astype(np.int32), size.astype(np.int32), path]
        for lo in range(0, len(doc), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 14)]) for c in cols], names=["doc_id", "fp", "start", "size", "path"])


def _spans(col: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each span, its fields) of a column of lists of structs."""
    flat = col.flatten()
    n = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy()
    return np.repeat(np.arange(len(col)), n), [flat.field(k).to_numpy() for k in range(flat.type.num_fields)]


def _digests(length: int):
    """The words at each source coordinate, as a digest. Columns: doc_id, text, fp, spans."""

    def run(batches):
        for b in batches:
            row, (start, size, path) = _spans(b.column(3))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            low, high = start.tolist(), (start + size + (length - 1)).tolist()
            digest: list[bytes] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = (text or "").encode().split()
                digest += [hashlib.blake2b(b" ".join(words[low[k] : high[k]]), digest_size=16).digest() for k in range(at[i], at[i + 1])]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(2).take(row), pa.array(start), pa.array(size), pa.array(path), pa.array(digest, pa.binary())],
                names=["doc_id", "fp", "start", "size", "path", "digest"])

    return run


def _paths(edges: DataFrame) -> DataFrame:
    """Compacted paths of repeated edges: path (hash of the head), size (edges). ``edges``: h, doc, start, fp, before, after."""
    onward = edges.where("after <> 0").select("doc", "fp", (F.col("start") + 1).alias("start"), F.lit(True).alias("reached"))
    linked = edges.join(onward, ["doc", "fp", "start"], "left")
    head = F.col("reached").isNull() | (F.col("before") == 0)
    along = Window.partitionBy("doc", "fp").orderBy("start")
    marked = linked.select("doc", "fp", "start", "h", head.alias("head")).withColumn("k", F.sum(F.col("head").cast("long")).over(along))
    return marked.groupBy("doc", "fp", "k").agg(F.max(F.when(F.col("head"), F.col("h"))).alias("path"), F.count("*").cast("int").alias("size")).select("path", "size")


def _later(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, fp, start, size, path, digest) that have an earlier one of equal path and digest."""
    first = spans.groupBy("path", "digest").agg(F.min(F.struct("doc_id", "start", "fp")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first)
    hot = first.where(F.col("n") > HOT)
    key, is_later = ["path", "digest"], F.struct("doc_id", "start", "fp") != F.col("first")
    if 0 < hot.count() <= BROADCAST_ROWS:
        few = F.broadcast(hot)
        both = spans.join(few, key).unionByName(spans.join(few, key, "left_anti").join(first.where(F.col("n") <= HOT), key))
    else:
        both = spans.join(first, key)
    return both.where(is_later).select("doc_id", "fp", "start", "size")


def _cover(length: int):
    def run(batches):
        for b in batches:
            row, (start, size) = _spans(b.column(3))
            order = np.lexsort((start, row))
            row, low, high = row[order], start[order], (start + size)[order] + (length - 1)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            out = [[repeats.merged(low[a:z], high[a:z]).tobytes()] if z > a else None for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "text", "cover"])

    return run


def _repeated(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text, cover: the words of each row of ``docs`` (doc_id, text, fp) that earlier windows cover."""
    spark = docs.sparkSession
    key = ["doc_id", "fp"]
    named = docs.where("doc_id is not null")
    n = min(BUCKETS, partitions(docs))
    opened = cut(seeds.opened(named, repeats.of_words, length, gram))
    rows = named.join(opened.hint("shuffle_hash"), key).select("doc_id", "text", "fp", "open")
    # the texts' shuffle is gone before the edges' begins
    edges = cut(rows.mapInArrow(_edges(length), _EDGES))
    table = f"marlstone_{uuid.uuid4().hex}"
    place = folder(spark, table)  # shared, and its files are not the catalog's to remove
    with tidy(spark):
        edges.repartition(n, "h").sortWithinPartitions("h").write.option("path", place).option("compression", "zstd").bucketBy(n, "h").sortBy("h").saveAsTable(table)
    drop(edges, opened)
    try:
        edges = spark.table(table)
        low, high = (lambda c: F.min(c)), (lambda c: F.max(c))
        repeated = edges.groupBy("h").agg(
            F.min(F.struct("doc", "at")).alias("first"), F.sum("n").alias("n"),
            F.when(low("before") == high("before"), low("before")).otherwise(0).alias("before"), F.when(low("after") == high("after"), low("after")).otherwise(0).alias("after"),
        ).where("n > 1")
        repeated = cut(repeated.select("h", F.col("first.doc").alias("doc"), F.shiftright("first.at", 32).cast("int").alias("start"), F.col("first.at").bitwiseAND(0xFFFFFFFF).alias("fp"), "before", "after"))
        paths = cut(_paths(repeated))
        found = edges.join(paths.withColumnRenamed("path", "h").hint("shuffle_hash"), "h").select(F.col("h").alias("path"), "size", "doc", "at", "others")
        found = cut(found.mapInArrow(_occurrences, "doc_id long, fp int, start int, size int, path long"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop(place)
    drop(repeated, paths)
    at = found.groupBy(*key).agg(F.collect_list(F.struct("start", "size", "path")).alias("spans"))
    seen = named.join(at.hint("shuffle_hash"), key).select("doc_id", "text", "fp", "spans")
    spans = cut(seen.mapInArrow(_digests(length), "doc_id long, fp int, start int, size int, path long, digest binary"))
    drop(found)
    gone = _later(spans).groupBy(*key).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    out = named.join(gone.hint("shuffle_hash"), key, "left").select("doc_id", "text", "fp", "spans")
    out = out.unionByName(docs.where("doc_id is null").withColumn("spans", F.lit(None).cast(out.schema["spans"].dataType)))
    return out.mapInArrow(_cover(length), "doc_id long, text string, cover array<binary>")


def _keep(with_text: bool):
    def run(batches):
        for b in batches:
            ids, covers = b.column(0), b.column(2).to_pylist()
            n_words, n_removed, kept, sha = [], [], [], []
            for text, cover in zip(b.column(1).to_pylist(), covers, strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                gone = 0
                if cover:
                    keep = np.ones(len(words), bool)
                    for lo, hi in repeats.ranges(cover):
                        keep[lo:hi] = False
                    gone = len(words) - int(keep.sum())
                    words = list(compress(words, keep))
                n_removed.append(gone)
                whole = b" ".join(words)
                sha.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def dedup_words(docs: DataFrame, length: int = WORDS, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Remove each word that a window of ``length`` words covers which also starts earlier.

    Returns doc_id, n_words, n_removed, kept_text (null unless ``with_text``) and kept_sha256.
    """
    return _repeated(repeats.with_fingerprint(docs), length, min(gram, length)).mapInArrow(_keep(with_text), _OUT)


def op5(spark, sf_dir: str) -> DataFrame:
    from marlstone.llm.session import table

    return dedup_words(table(spark, sf_dir, "documents", True), with_text=False).drop("kept_text")
