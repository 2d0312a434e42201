"""Connected components of an edge list, in arrays and in tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.session import materialize


def min_label(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of ``parent`` (every entry points at its set's smallest member) along the pairs (i, j)."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node of the component.

    Alternating large-star and small-star rounds: every round is one or two grouped minima and joins on the node, and
    the number of edges never grows. The edge list is written to the shared folder each round, so lost executors cost
    that round at most.
    """
    e = materialize(_downward(edges), "edges")
    for _ in range(rounds):
        large = _star(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = materialize(_star(_downward(large), False), "edges")
        # A forest of stars: no root is anyone's child.
        done = small.select(F.col("a").alias("b")).join(small, "b", "left_semi").isEmpty()
        if done and _same(e, small):
            return small.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                small.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        e = small
    raise RuntimeError("components did not settle")


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the smaller node ``a`` to the larger ``b``."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _same(x: DataFrame, y: DataFrame) -> bool:
    def sums(df: DataFrame):
        h = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())

    return sums(x) == sums(y)


def _star(neighbours: DataFrame, larger: bool) -> DataFrame:
    """Large star: both directions in, every larger neighbour of ``a`` to the smallest of all. Small star: see below."""
    if larger:
        least = neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = neighbours.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        # Of node b, its smaller neighbours a and itself go to the smallest of them.
        least = neighbours.groupBy("b").agg(F.min("a").alias("m"))
        out = neighbours.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), "b")
        out = out.select(F.col("x").alias("a"), F.explode(F.array("y", "b")).alias("b"))
    return _downward(out)
