"""Connected components by alternating large and small stars, on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a and b).

    A component is named by its smallest node.  Each round is two grouped
    minima and two joins over edges, written to the shared folder; minima are
    combined before the shuffle, and adaptive execution splits the join of a
    node with very many edges.  Only a count and a checksum reach the driver.
    Self-loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    before = _state(edges)
    for _ in range(rounds if before[0] else 0):
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def forest(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """Edges that join what the links (p, q) join, at most one for each of ``n`` rows."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, p, root[q])
        np.minimum.at(low, q, root[p])
        low = np.minimum(low, low[low])
        if (low == root).all():
            at = np.flatnonzero(root != np.arange(n))
            return np.stack([at, root[at]], 1)
        root = low
