"""Near-duplicate vectors: spherical k-means cells and blocked cosine products, without a missed pair.

Only vectors of one label and one length are compared. Equal rows of components are one class with a count. Every
vector has a home cell, that of its nearest centroid, and visits each cell that could hold a neighbour: where y's home is
c' and x's is c, y lies beyond the bisector of c and c', so x can reach it only if its own distance to that plane is at
most the sine of the largest angle allowed. Visitors of a cell are compared with its home vectors by matrix products in
double precision. Both come in blocks, each pair of which is a group of its own, so no task holds more than two
blocks however large or hot a cell is. A task returns sums and a spanning forest of its links.

k-means is fitted on at most SAMPLE vectors or SAMPLE_BYTES (smallest hashes of their ids); it decides where work is done, never
what is linked. There are at most MAX_CELLS cells; beyond it cells grow, in blocks. Vectors without structure, all about
at right angles, visit every cell: exact counts of links then take work of the square of a label's vectors, as any exact way does.
Vectors of another length than the commonest share one cell of blocks. A null label, a null, zero-length or zero vector, and null or non-finite components link with nothing. Each row
counts as a vector; rows that share a vec_id share a component. A null vec_id has no links, a null component and is
kept. Ties (equal similarities, repeated rows) all count. Very long vectors are compared like others. An empty table gives an
empty result. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marlstone.llm import graph
from marlstone.llm.session import cut, drop, partitions, table

COSINE = 0.93
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: home vectors that a cell should have, cells at most, vectors of one side of a comparison at most
CELL = 8192
MAX_CELLS = 4096
BLOCK = 8192
#: rows of a table that is broadcast, after they were counted
BROADCAST_ROWS = 200_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors, by cosine."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(near[order]) != 0))
        sums = np.add.reduceat(x[order], at, axis=0)
        norm = np.sqrt((sums * sums).sum(1))
        ok = norm > 1e-9
        c[near[order][at][ok]] = sums[ok] / norm[ok, None]
    return c


def visits(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each vector, mask of the cells where its neighbours can be)."""
    d = x @ c.T
    home = d.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * np.clip(c @ c.T, -1, 1), 0))[home]
    out = d[np.arange(len(x)), home][:, None] - d <= np.sqrt(1 - cosine * cosine) * apart + 1e-9
    out[np.arange(len(x)), home] = True
    return home, out


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def _place(c: np.ndarray, cosine: float):
    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            home = np.zeros(b.num_rows, np.int32)
            cells: list[list[int]] = [[0]] * b.num_rows
            mine = np.flatnonzero(dims == c.shape[1])
            for a in range(0, len(mine), 1024):
                at = mine[a : a + 1024]
                h, seen = visits(unit(_matrix(b.column(4).take(pa.array(at)))), c, cosine)
                home[at] = h
                for i, row in zip(at.tolist(), seen, strict=True):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], names=["rep", "label", "dim", "n", "vec", "cid", "home", "cells"])

    return run


def _compare(cosine: float):
    """Rows (label, dim, cell, i, j, side, rep, n, vec, cid), homes (side 0) before visitors, to (cid, links, null) and (rep, null, rep)."""

    def close(homes, guests):
        if not homes or not guests:
            return None
        rep_h, n_h, h, cid_h = (np.concatenate(x) for x in zip(*homes, strict=True))
        rep_g, _, g, cid_g = (np.concatenate(x) for x in zip(*guests, strict=True))
        h, g = unit(h), unit(g)
        links = np.zeros(len(g), np.int64)
        a, b = [], []
        for lo in range(0, len(g), 512):
            near = g[lo : lo + 512] @ h.T >= cosine
            near &= cid_g[lo : lo + 512, None] != cid_h[None, :]
            links[lo : lo + 512] = near @ n_h
            p, q = np.nonzero(near)
            if len(p):
                x, y = graph.forest(rep_g[lo + p], rep_h[q])
                a.append(x)
                b.append(y)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        x, y = graph.forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([cid_g[some], x])), pa.array([*links[some].tolist(), *[None] * len(x)], pa.int64()), pa.array([*[None] * len(some), *y.tolist()], pa.int64())],
            names=["a", "links", "b"])

    def run(batches):
        now, sides = None, ([], [])
        for t in batches:
            keys = list(zip(*(t.column(k).to_pylist() for k in range(6)), strict=True))
            at = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi <= lo:
                    continue
                if keys[lo][:5] != now:
                    if (out := close(*sides)) is not None:
                        yield out
                    now, sides = keys[lo][:5], ([], [])
                part = t.slice(lo, hi - lo)
                sides[keys[lo][5]].append((part.column(6).to_numpy(), part.column(7).to_numpy(), _matrix(part.column(8)), part.column(9).to_numpy()))
        if (out := close(*sides)) is not None:
            yield out

    return run


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    n = partitions(vectors)
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # travels as it is, half as wide
    vec = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), F.col("label").cast("string").alias("label"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    rows = v.where("good")
    classes = rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = cut(classes.select("rep", "label", F.size("vec").alias("dim"), "n", "vec", "h1", "h2", F.xxhash64("label", "h1", "h2").alias("cid")))
    plain = classes.select("rep", "label", "dim", "n", "vec", "cid")
    most = plain.groupBy("label", "dim").count().orderBy(F.desc("count"), "label", "dim").first()
    if most:
        k = int(max(2, min(MAX_CELLS, -(-most["count"] // CELL))))
        some = max(k, min(SAMPLE, SAMPLE_BYTES // (8 * most["dim"])))
        sample = plain.where(F.col("dim") == most["dim"]).select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(some).collect()
        c = k_means(unit(np.array([r.vec for r in sample], np.float64)), k)
    else:
        c = np.ones((1, 1))
    placed = cut(plain.mapInArrow(_place(c, cosine), f"rep long, label string, dim int, n long, vec {v.schema['vec'].dataType.simpleString()}, cid long, home int, cells array<int>"))
    cell = ["label", "dim", "cell"]
    homes, guests = placed.withColumn("cell", F.col("home")), placed.withColumn("cell", F.explode("cells"))
    counts = homes.groupBy(*cell).agg(F.count("*").alias("h"), F.lit(0).alias("g")).unionByName(guests.groupBy(*cell).agg(F.lit(0).cast("long").alias("h"), F.count("*").alias("g")))
    counts = cut(counts.groupBy(*cell).agg(F.ceil(F.sum("h") / BLOCK).cast("int").alias("hb"), F.ceil(F.sum("g") / BLOCK).cast("int").alias("gb")).where("hb > 0"))
    counts_table = counts
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    mine = lambda blocks: F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    homes = homes.join(counts, cell).select(*cell, mine("hb").alias("i"), every("gb").alias("j"), F.lit(0).alias("side"), "rep", "n", "vec", "cid")
    guests = guests.join(counts, cell).select(*cell, every("hb").alias("i"), mine("gb").alias("j"), F.lit(1).alias("side"), "rep", "n", "vec", "cid")
    key = [*cell, "i", "j"]
    met = homes.unionByName(guests).repartition(n, *key).sortWithinPartitions(*key, "side")
    met = cut(met.mapInArrow(_compare(cosine), "a long, links long, b long"))
    sums = met.where("links is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    # copies learn of their class; where there are few classes of copies, their rows stay where they are, however many they are
    copied = classes.where("n > 1").select("label", "h1", "h2", "rep", "n", "cid").join(sums, "cid", "left")
    copied = cut(copied.select("label", "h1", "h2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    few = copied.count() <= BROADCAST_ROWS
    told = rows.select("vec_id", "label", "h1", "h2").join(F.broadcast(copied) if few else copied, ["label", "h1", "h2"], "left")
    same = told.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    single = told.where("rep is null").select("vec_id", F.xxhash64("label", "h1", "h2").alias("cid")).join(sums, "cid", "left")
    linked = told.where("rep is not null").select("vec_id", "n_links").unionByName(single.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")))
    roots = graph.components(met.where("b is not null").select("a", "b").unionByName(same))
    drop(placed, counts_table)
    named = v.where("not good and vec_id is not null").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(named)
    out = out.join(roots.withColumnRenamed("node", "vec_id").hint("shuffle_hash"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id"), (F.col("root").isNull() | (F.col("root") == F.col("vec_id"))).alias("kept"))
    none = v.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def op4(spark, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings", True))
