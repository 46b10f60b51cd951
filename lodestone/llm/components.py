"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task, written

#: Edges that one task solves by itself; more are solved in star steps.
ALONE = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a few edges, as edges from each node to the smallest one of its component: fewer
    than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(low, root[x], least)
        np.minimum.at(low, root[y], least)
        while (low != low[low]).any():
            low = low[low]
        low = low[root]
        if (low == root).all():
            break
        root = low
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) as stars of each task: a task hands on fewer edges than it has nodes."""

    def run(batches):
        u = v = np.zeros(0, np.int64)
        for batch in batches:
            u, v = stars(np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()]))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(task(run), "u long, v long")


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _solved(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n")).filter("up > 1 OR (up = 1 AND n > 1)").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(u, v) for all nodes u of edges (a, b) that reach a smaller one, v the smallest of these; written.

    Each task first hands on only stars of what it holds, so of a few components few edges are left.  Up
    to ALONE edges are solved in one task.  In the star steps, a node with many links is summed up before
    the shuffle; its links are rows of a join, never one group in a task.  Each round writes its edges, so
    a lost executor repeats part of one round.  Null ends are not allowed.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    e = written(contracted(pairs), "edges")
    if (n := e.count()) > ALONE:
        e = written(contracted(e.distinct()), "edges")
        n = e.count()
    while n > ALONE:
        if _solved(e):
            return e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        m = _min_neighbour(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = written(contracted(small), "edges")
        n = e.count()
    return written(contracted(e.repartition(1)), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the smallest node that each one reaches.  Self links
    are allowed and give components of one."""
    e = roots(edges)
    # every node but the smallest of its component has one edge, to that smallest node
    linked = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", F.col("v").alias("component")).distinct())
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct()
    return linked.union(alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
