"""Connected components: contraction inside tasks, then alternating large and small stars over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.session import cut, drop, prepare

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges a-b but those smallest themselves."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: edges that one task holds
CHUNK = 1 << 20


def _contract(batches):
    """A spanning forest of each CHUNK of edges: from each node to the smallest that it reaches there."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n > CHUNK:
            yield edge_batch(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held, n = [], 0
    if held:
        yield edge_batch(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))


#: a node with more edges than that is hot: its neighbours don't travel to it, what is known of it is broadcast
HOT = 1000
BROADCAST_ROWS = 200_000


def _hot(both: DataFrame, most: int) -> DataFrame | None:
    """Hot nodes, if there are any and few. They number at most a HOTth of the edges; that is counted before they are broadcast."""
    if most <= HOT:
        return None
    hot = cut(both.groupBy("u").count().where(F.col("count") > HOT).select("u"))
    return F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else None


def _told(rows: DataFrame, known: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` (u, v) with what is ``known`` of each u."""
    if hot is None:
        return rows.join(known, "u")
    return rows.join(F.broadcast(known.join(hot, "u")), "u").unionByName(rows.join(hot, "u", "left_anti").join(known.join(hot, "u", "left_anti"), "u"))


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): the smallest node that each can reach. Nodes alone aren't returned."""
    prepare(edges.sparkSession)
    e = edges.select("a", "b").where("a <> b").mapInArrow(_contract, EDGES).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    mark = _digest(e)
    if mark[0] <= 2 * CHUNK:  # counted, each edge in both directions: one task holds them all, so one contraction is the answer
        return cut(e.coalesce(1).mapInArrow(_contract, EDGES).select(F.col("a").alias("node"), F.col("b").alias("root")))
    while mark[0]:
        both = _both(e)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hot = _hot(both, mark[2])
        large = _told(both.where("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        rest = _told(large, low.withColumnRenamed("v", "m"), hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(low.unionByName(rest).distinct())
        drop(old)
        new = _digest(e)
        if new[:2] == mark[:2]:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(e: DataFrame) -> tuple[int, int, int]:
    """(edges, a hash of them all, most edges of one node)."""
    of_node = _both(e).groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    n, x, most = of_node.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    return n or 0, x or 0, most or 0
