"""The batch jobs end to end: cells to polygon chunks, chunks to derived tables, tables to model input.

Every job is restartable: finished chunks and valid outputs are left alone unless ``force`` is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.functions import timefn as T
from arealcast.operators import areal as AR
from arealcast.operators import climatology as C
from arealcast.operators import graph as G
from arealcast.operators import model_prep as M
from arealcast.operators import verify as V
from arealcast.sources import chunks as CH
from arealcast.sources import tables as TB
from arealcast.sources.published import publish


def aggregate_forecasts(
    cells: DataFrame, weights: DataFrame, path: str, var: str = "t2m", force: bool = False
) -> bool:
    """Forecast cells (valid_time, lead_time) to polygon chunks by init month and lead."""
    rows = cells.withColumn("init_time", T.init_time(F.col("valid_time"), F.col("lead_time")))
    return CH.resume(rows, path, "fc", lambda df: AR.forecast_means(df, weights, var), force)


def aggregate_analyses(
    cells: DataFrame, weights: DataFrame, path: str, var: str = "t2m", force: bool = False
) -> bool:
    """Analysis cells (time) to polygon chunks by month."""
    return CH.resume(cells, path, "an", lambda df: AR.area_weighted_mean(df, weights, var, ["time"]), force)


def aggregate_reanalysis(
    cells: DataFrame, weights: DataFrame, path: str, var: str = "t2m", force: bool = False
) -> bool:
    """Hourly cells to daily polygon means by month, leap days left out."""

    def build(df: DataFrame) -> DataFrame:
        daily = C.daily_mean(C.drop_leap_days(df), var)
        return AR.area_weighted_mean(daily, weights, var, ["time"])

    return CH.resume(cells, path, "daily", build, force)


def build_climatology(spark: SparkSession, daily_chunks: str, path: str, force: bool = False) -> bool:
    daily = TB.read_table(spark, daily_chunks)
    return TB.write_table(C.climatology(C.drop_leap_days(daily)), path, "clim", force)


def derive_bias(
    spark: SparkSession, forecasts: str, analyses: str, area: DataFrame, path: str, force: bool = False
) -> bool:
    """Bias table of one model from its chunk folders."""
    bias = V.bias_table(TB.read_table(spark, forecasts), TB.read_table(spark, analyses), area)
    return TB.write_table(bias, path, "bias", force)


def derive_anomalies(
    spark: SparkSession, bias: str, clim: str, path: str, force: bool = False
) -> bool:
    """Anomaly table from the stored bias table; nothing is written while the climatology is absent."""
    normals = TB.read_if_present(spark, clim)
    if normals is None:
        return False
    return TB.write_table(V.anomaly_table(TB.read_table(spark, bias), normals), path, "anom", force)


def derive_comparison(
    spark: SparkSession, first: str, second: str, area: DataFrame, path: str, force: bool = False
) -> bool:
    table = V.model_comparison(TB.read_table(spark, first), TB.read_table(spark, second), area)
    return TB.write_table(table, path, "comparison", force)


def summarise_categories(cells: DataFrame, weights: DataFrame, path: str, force: bool = False) -> bool:
    """Top-two categories per polygon."""
    return TB.write_table(AR.top_two(AR.category_fractions(cells, weights)), path, "category", force)


def store_graph(polygons: DataFrame, edges: str, nodes: str, keys: Sequence[str] = ()) -> None:
    """Node order and edge list of a polygon layer as two tables."""
    publish(G.node_table(polygons), nodes)
    stored = TB.read_table(polygons.sparkSession, nodes)
    publish(G.edge_table(G.queen_neighbours(polygons, keys), stored), edges)


def store_model_input(
    bias: DataFrame, categories: DataFrame | None, census: DataFrame, covariates: Sequence[str], path: str
) -> None:
    publish(M.model_input(bias, categories, census, covariates), path)
