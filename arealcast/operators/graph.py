"""Neighbour graphs of polygon layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.operators.ordering import with_row_number


def node_table(polygons: DataFrame) -> DataFrame:
    """geo_id and its 0-based position in id order."""
    ids = polygons.select("geo_id").distinct()
    return with_row_number(ids, ["geo_id"], name="_rn").select(
        "geo_id", (F.col("_rn") - 1).cast("int").alias("node_idx")
    )


def queen_neighbours(polygons: DataFrame, keys: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Ordered pairs (geo_id, neighbour) of polygons that share at least one vertex, both directions.

    Vertices are first reduced to one row per polygon and position, so a repeated vertex adds no pairs;
    ``keys`` separate layers that reuse the same coordinates.
    """
    keys = list(keys)
    vertex = (
        polygons.select(*keys, "geo_id", F.explode(F.flatten("rings")).alias("p"))
        .select(*keys, "geo_id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y"))
        .distinct()
    )
    other = vertex.withColumnRenamed("geo_id", "neighbour")
    return (
        vertex.join(other, [*keys, "x", "y"])
        .where(F.col("geo_id") != F.col("neighbour"))
        .select("geo_id", "neighbour")
        .distinct()
    )


def edge_table(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbour pairs as node indices (src, dst)."""
    src = nodes.select("geo_id", F.col("node_idx").alias("src"))
    dst = nodes.select(F.col("geo_id").alias("neighbour"), F.col("node_idx").alias("dst"))
    return neighbours.join(src, "geo_id").join(dst, "neighbour").select("src", "dst")


def upper_triangle(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") < F.col("dst"))


def neighbour_stats(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Node, island and non-zero counts and the mean number of neighbours."""
    degree = neighbours.groupBy("geo_id").agg(F.count(F.lit(1)).alias("_d"))
    d = F.coalesce("_d", F.lit(0))
    return nodes.join(degree, "geo_id", "left").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(d == 0).alias("n_islands"),
        F.avg(d).alias("mean_neighbours"),
        F.sum(d).alias("n_nonzero"),
    )


def edge_energy(neighbours: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """-1/2 times the sum of squared differences over undirected edges."""
    a = values.select("geo_id", F.col(value).alias("_a"))
    b = values.select(F.col("geo_id").alias("neighbour"), F.col(value).alias("_b"))
    once = neighbours.where(F.col("geo_id") < F.col("neighbour"))
    return (
        once.join(a, "geo_id")
        .join(b, "neighbour")
        .agg(
            (F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2))) * -0.5).alias("energy"),
            F.count(F.lit(1)).alias("n_edges"),
        )
    )
