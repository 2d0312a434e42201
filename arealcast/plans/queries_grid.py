"""Registered queries over grid cells, polygons and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.functions import timefn as T
from arealcast.operators import areal as AR
from arealcast.operators import climatology as C
from arealcast.operators import grid as GR
from arealcast.operators import spatial as SP
from arealcast.plans.registry import Tables, query, rounded
from arealcast.plans.standins import LAT0, LON0, STEP
from arealcast.session import shared_dir
from arealcast.sources.weights import cached_weights, weight_keys

DOMAIN = ["grid_id"]


#: Store of weights by session and data folder.
_STORES: dict[tuple[str, str], str] = {}


def _weights(t: Tables) -> DataFrame:
    """Weights from the session's store: the first query that needs a grid's weights fills it."""
    own = (t.spark.sparkContext.applicationId, t.dir)
    if own not in _STORES:
        _STORES[own] = shared_dir(t.spark, "weights")
    return cached_weights(t.spark, _STORES[own], t.cells(), t.polygons(), t.dir, "", tuple(DOMAIN))


def _mean_obs(t: Tables) -> DataFrame:
    """Cell observations with repeated (cell, time) rows averaged."""
    return (
        t.cell_observations()
        .groupBy("grid_id", "lat", "lon", "time")
        .agg(*[F.avg(c).alias(c) for c in ("f", "a", "c")])
    )


def _region_polygons(t: Tables) -> DataFrame:
    """Polygons of the states of one region."""
    nations = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chosen = nations.where(F.col("r_name") == "ASIA").select(F.col("n_nationkey").alias("statefp"))
    return t.polygons().join(chosen, "statefp", "left_semi")


def _boxes(t: Tables) -> DataFrame:
    return t.cells().groupBy("grid_id").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")
    )


@query
def cell_bounds(t: Tables) -> DataFrame:
    return rounded(GR.grid_cells(t.cells()))


@query
def cell_polygon_weights(t: Tables) -> DataFrame:
    w = SP.overlap_weights(GR.grid_cells(t.cells()), t.polygons(), DOMAIN)
    return rounded(w.withColumn("w", F.col("w") * 1000))


@query
def area_weighted_mean(t: Tables) -> DataFrame:
    return rounded(AR.area_weighted_mean(t.cells(), _weights(t)))


@query
def area_weighted_series(t: Tables) -> DataFrame:
    return rounded(AR.area_weighted_mean(t.cell_observations(), _weights(t), "f", ["time"]))


@query
def area_forecasts(t: Tables) -> DataFrame:
    cells = t.cell_observations().select(
        "grid_id", "lat", "lon", F.col("time").alias("valid_time"), "lead_time", F.col("a").alias("t2m")
    )
    return rounded(AR.forecast_means(cells, _weights(t)))


@query
def area_daily_means(t: Tables) -> DataFrame:
    """Daily cell means first, then the polygon mean of each day."""
    daily = C.daily_mean(t.cell_observations(), "f")
    return rounded(AR.area_weighted_mean(C.drop_leap_days(daily), _weights(t), "f", ["time"]))


@query
def category_fractions(t: Tables) -> DataFrame:
    return rounded(AR.category_fractions(t.cells(), _weights(t)))


@query
def category_fractions_known(t: Tables) -> DataFrame:
    return rounded(AR.category_fractions(t.cells(), _weights(t), ignore_missing=True))


@query
def category_top2(t: Tables) -> DataFrame:
    return rounded(AR.top_two(AR.category_fractions(t.cells(), _weights(t))))


@query
def daily_mean(t: Tables) -> DataFrame:
    return rounded(C.daily_mean(t.cell_observations(), "f"))


@query
def regular_grid(t: Tables) -> DataFrame:
    return rounded(GR.regular_grid(_boxes(t), 0.3))


@query
def regrid_nearest(t: Tables) -> DataFrame:
    targets = GR.regular_grid(_boxes(t), 0.3)
    return rounded(GR.regrid_nearest(t.cells().select("grid_id", "lat", "lon", "value"), targets, LAT0, LON0, STEP))


@query
def regrid_bilinear(t: Tables) -> DataFrame:
    targets = GR.regular_grid(_boxes(t), 0.05).select("grid_id", "lat", "lon")
    return rounded(GR.regrid_bilinear(t.cells().select("grid_id", "lat", "lon", "value"), targets, LAT0, LON0, STEP))


@query
def cos_lat_mean(t: Tables) -> DataFrame:
    return rounded(GR.cos_lat_mean(t.cell_observations(), "f"))


@query
def cell_rmse_components(t: Tables) -> DataFrame:
    return rounded(GR.cell_rmse_components(_mean_obs(t)))


@query
def cell_mae(t: Tables) -> DataFrame:
    return rounded(GR.cell_mae(_mean_obs(t)))


@query
def cell_mae_season(t: Tables) -> DataFrame:
    rows = _mean_obs(t).withColumn("season", T.season_of_month(F.month("time")))
    return rounded(GR.cell_mae(rows, by=["season"]))


@query
def cube_marginals(t: Tables) -> DataFrame:
    return rounded(GR.marginal_means(t.cell_observations(wide=True), "f"))


@query
def reconstruction_rmse(t: Tables) -> DataFrame:
    return rounded(GR.reconstruction_rmse(t.cell_observations(), "f", "a"))


@query
def reconstruction_rmse_cell(t: Tables) -> DataFrame:
    return rounded(GR.reconstruction_rmse(t.cell_observations(), "f", "a", ["grid_id", "lat", "lon"]))


@query
def lat_profile(t: Tables) -> DataFrame:
    return rounded(GR.lat_profiles(t.cell_observations(wide=True), "f"))


@query
def detrend_linear(t: Tables) -> DataFrame:
    indexed = GR.with_time_index(_mean_obs(t).select("grid_id", "lat", "lon", "time", "f"))
    return rounded(GR.detrend(indexed, "f"))


@query
def series_trend(t: Tables) -> DataFrame:
    series = t.cell_observations().groupBy("time").agg(F.avg("f").alias("f"))
    trend = GR.linear_trend(GR.with_time_index(series), "f")
    return rounded(trend.withColumn("slope", F.col("slope") * 1e6))


@query
def grid_anomaly(t: Tables) -> DataFrame:
    obs = C.drop_leap_days(_mean_obs(t))
    clim = (
        obs.withColumn("day_of_year", T.noleap_doy(F.col("time")))
        .groupBy("grid_id", "lat", "lon", "day_of_year")
        .agg(F.avg("c").alias("clim"))
    )
    return rounded(
        C.grid_climatology_anomaly(obs.select("grid_id", "lat", "lon", "time", "f"), clim, "f")
    )


@query
def bounding_box(t: Tables) -> DataFrame:
    """Longitudes given as 0..360 are wrapped before the box is applied."""
    east = t.cells().select("grid_id", "lat", (F.col("lon") + 360.0).alias("lon"), "value")
    return rounded(GR.bounding_box(east, 0.5, 3.5, -124.0, -120.0))


@query
def level_mean_height(t: Tables) -> DataFrame:
    fields = t.cell_observations().select(
        "grid_id", "lat", "lon", "time", (F.col("lead_time") / 24 * 100).alias("level"), (F.col("f") * 196).alias("value")
    )
    return rounded(GR.level_mean(fields, 500.0, box=(0.0, 45.0, -124.5, -119.5)))


@query
def point_in_polygon(t: Tables) -> DataFrame:
    points = t.cells().select("grid_id", "lat", "lon")
    return rounded(SP.points_in_polygons(points, _region_polygons(t), DOMAIN))


@query
def cells_within_polygon(t: Tables) -> DataFrame:
    return rounded(SP.join_cells(GR.grid_cells(t.cells()), t.polygons(), "within", DOMAIN))


@query
def cells_intersecting_polygon(t: Tables) -> DataFrame:
    return rounded(SP.join_cells(GR.grid_cells(t.cells()), t.polygons(), "intersects", DOMAIN))


@query
def cell_attribute_means(t: Tables) -> DataFrame:
    joined = SP.join_cells(GR.grid_cells(t.cells()), t.polygons(), "intersects", DOMAIN)
    return rounded(SP.cell_means(joined, t.land_area(), ["aland"]))


@query
def polygon_text_area(t: Tables) -> DataFrame:
    """Rings written as text, read back, and measured in the longitude-latitude plane."""
    text = t.polygons().select("geo_id", SP.wkt_from_rings(F.col("rings")).alias("wkt"))
    rings = SP.rings_from_wkt(F.col("wkt"))
    return rounded(text.select("geo_id", SP.polygon_area(rings).alias("area")))


@query
def weight_table_key(t: Tables) -> DataFrame:
    return weight_keys(t.cells(), "polygons.parquet", "2024-01-01")


@query
def stored_weights(t: Tables) -> DataFrame:
    """Weights from the keyed store, filled on first use and found there on the second."""
    root = shared_dir(t.spark, "weights")
    for _ in range(2):
        w = cached_weights(t.spark, root, t.cells(), t.polygons(), "polygons.parquet", "2024-01-01", ("grid_id",))
    return rounded(w.withColumn("w", F.col("w") * 1000))


@query
def gridded_scan(t: Tables) -> DataFrame:
    """A field with other coordinate names and longitudes from 0 to 360."""
    raw = t.cell_observations().select(
        "grid_id",
        F.col("lat").alias("latitude"),
        (F.col("lon") + 360.0).alias("longitude"),
        F.col("time").alias("valid_time"),
        F.when(F.col("f") > 320.0, float("nan")).otherwise(F.col("f")).alias("f"),
    )
    return rounded(GR.gridded_scan(raw, "f"))


@query
def area_attributes(t: Tables) -> DataFrame:
    return rounded(t.area().select("geo_id", S.m2_to_km2(F.col("aland_m2")).alias("aland")))


@query
def cell_error_cube(t: Tables) -> DataFrame:
    """Gridded error written out by the exploration jobs."""
    obs = _mean_obs(t)
    return rounded(
        obs.select("grid_id", "lat", "lon", "time", S.bias(F.col("f"), F.col("a")).alias("error"))
    )
