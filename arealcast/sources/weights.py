"""Stored weight tables, keyed by what they were built from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.operators.grid import grid_cells
from arealcast.operators.spatial import overlap_weights
from arealcast.sources.published import publish, read_published

# Fixed value: length of a key.
KEY_CHARS = 16
SCHEMA = "fill string, key string, domain string, grid_id int, geo_id string, lat double, lon double, w double"


def weight_keys(cells: DataFrame, source: str, modified: str) -> DataFrame:
    """One key per grid: hash of the polygon source, its modification stamp and the sorted axes.

    An axis has one entry per row or column of a grid, never one per cell or time.
    """
    axis = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("double"))).cast("array<string>"), ",")
    text = F.concat_ws("|", F.lit(source), F.lit(modified), axis("lat"), axis("lon"))
    return cells.groupBy("grid_id").agg(F.substring(F.sha2(text, 256), 1, KEY_CHARS).alias("key"))


def cached_weights(
    spark: SparkSession,
    root: str,
    cells: DataFrame,
    polygons: DataFrame,
    source: str,
    modified: str,
    domain: tuple[str, ...] = (),
) -> DataFrame:
    """Weights of the grids in ``cells``, computed and stored only where they are not yet under ``root``.

    Grids of equal axes share a key but not their polygons, so what is stored belongs to a key, a grid and the columns
    ``domain`` that tie polygons to grids. Each is entered in a table of what is stored, with its number of rows, once
    its weights are written: a grid without any overlap counts as done, and one whose job stopped half way does not. The
    stored table is read back, so its true size is known to the optimizer when it picks the join.
    """
    keys = weight_keys(cells, source, modified).withColumn("domain", F.lit(",".join(domain)))
    own = ["grid_id", "key", "domain"]
    root = root.rstrip("/")
    done = read_published(spark, f"{root}/stored")
    wanted = keys if done is None else keys.join(done, own, "left_anti")
    # Only keys travel to the driver, one per grid.
    if not wanted.isEmpty():
        todo = grid_cells(cells.join(wanted, "grid_id", "left_semi"))
        fresh = overlap_weights(todo, polygons, domain).select("grid_id", "geo_id", "lat", "lon", "w").join(wanted, "grid_id")
        fill = uuid.uuid4().hex
        fresh.withColumn("fill", F.lit(fill)).write.mode("append").partitionBy("fill", "key").parquet(f"{root}/weights")
        entry = wanted.withColumn("fill", F.lit(fill))
        publish((entry if done is None else done.unionByName(entry)).coalesce(1), f"{root}/stored")
    entries = read_published(spark, f"{root}/stored").join(keys, own, "left_semi")
    stored = spark.read.schema(SCHEMA).parquet(f"{root}/weights")
    return stored.join(entries, [*own, "fill"], "left_semi").drop("key", "domain", "fill")
