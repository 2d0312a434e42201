"""Operators on long-format grid cells (grid_id, time, lat, lon, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.functions.ids import first_present
from arealcast.operators.ordering import with_row_number

CELL = ["grid_id", "lat", "lon"]


def axis_bounds(cells: DataFrame, axis: str, grid: str = "grid_id") -> DataFrame:
    """Distinct coordinates of one axis per grid with their cell bounds.

    Bounds are midpoints; the outer ones mirror the neighbouring half step; a lone coordinate gets +-0.5.
    """
    w = Window.partitionBy(grid).orderBy(axis)
    before, after = F.lag(axis).over(w), F.lead(axis).over(w)
    c = F.col(axis)
    return (
        cells.select(grid, axis)
        .distinct()
        .withColumn("_down", c - before)
        .withColumn("_up", after - c)
        .select(
            grid,
            axis,
            (c - F.coalesce("_down", "_up", F.lit(1.0)) / 2).alias(f"{axis}_lo"),
            (c + F.coalesce("_up", "_down", F.lit(1.0)) / 2).alias(f"{axis}_hi"),
        )
    )


def grid_cells(cells: DataFrame) -> DataFrame:
    """One row per cell with its bounds."""
    return (
        cells.select(*CELL)
        .distinct()
        .join(axis_bounds(cells, "lat"), ["grid_id", "lat"])
        .join(axis_bounds(cells, "lon"), ["grid_id", "lon"])
        .select(*CELL, "lat_lo", "lat_hi", "lon_lo", "lon_hi")
    )


def bounding_box(cells: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Wrap longitudes to [-180, 180) and keep the cells inside the closed box."""
    return cells.withColumn("lon", S.wrap_longitude(F.col("lon"))).where(
        F.col("lat").between(south, north) & F.col("lon").between(west, east)
    )


def level_mean(
    fields: DataFrame, level: float, value: str = "value", box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Time mean of one vertical level, geopotential turned into height."""
    out = fields.where(F.col("level") == level)
    if box is not None:
        out = bounding_box(out, *box)
    return out.groupBy(*CELL).agg(S.geopotential_height(F.avg(value)).alias("height"))


def regular_grid(box: DataFrame, step: float) -> DataFrame:
    """Grid points over each box (south, north, west, east), ``step`` apart, with running indices.

    Rows of all grids are dealt out to a fixed number of tasks before they are filled in: left to their size, which is
    small until then, they would be gathered in a few.
    """
    n = lambda lo, hi: F.floor((F.col(hi) - F.col(lo)) / step + 1e-9).cast("int")
    tasks = int(box.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        box.withColumn("i", F.explode(F.sequence(F.lit(0), n("south", "north"))))
        .repartition(tasks, *box.columns, "i")
        .withColumn("j", F.explode(F.sequence(F.lit(0), n("west", "east"))))
        .withColumn("lat", F.col("south") + F.col("i") * step)
        .withColumn("lon", F.col("west") + F.col("j") * step)
        .drop("south", "north", "west", "east")
    )


def _indexed(source: DataFrame, value: str, keys: Sequence[str], lat0: float, lon0: float, step: float) -> DataFrame:
    return source.select(
        *keys,
        F.round((F.col("lat") - lat0) / step).cast("int").alias("_i"),
        F.round((F.col("lon") - lon0) / step).cast("int").alias("_j"),
        F.col(value),
    )


def gridded_scan(df: DataFrame, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Normalise a scanned field: grid_id, lat, lon, an optional time, ``extra`` and the value.

    Latitude, longitude and time may carry their common other names; longitudes are wrapped; NaN becomes
    NULL. A missing value column or a further dimension is an error.
    """
    if value not in df.columns:
        raise KeyError(f"variable {value!r} not in {df.columns}")
    lat = first_present(df, ["lat", "latitude"])
    lon = first_present(df, ["lon", "longitude"])
    times = [c for c in df.columns if c.lower() in ("time", "valid_time")]
    known = {lat, lon, "grid_id", value, *times, *extra}
    unknown = [c for c in df.columns if c not in known]
    if unknown or len(times) > 1:
        raise ValueError(f"unsupported dimensions {unknown or times}")
    grid = F.col("grid_id") if "grid_id" in df.columns else F.lit(0)
    kind = df.schema[value].dataType.typeName()
    v = S.nan_to_null(F.col(value)) if kind in ("double", "float") else F.col(value)
    return df.select(
        grid.alias("grid_id"),
        F.col(lat).alias("lat"),
        S.wrap_longitude(F.col(lon)).alias("lon"),
        *[F.col(c).alias("time") for c in times],
        *extra,
        v.alias(value),
    )


def regrid_nearest(
    source: DataFrame,
    targets: DataFrame,
    lat0: float,
    lon0: float,
    step: float,
    value: str = "value",
    keys: Sequence[str] = ("grid_id",),
) -> DataFrame:
    """Value of the nearest source cell at every target point; a tie goes to the lower index.

    Source axes are regular (origin ``lat0``, ``lon0``), so the nearest cell is an index and the lookup an
    equi-join. Targets outside the source keep a NULL value.
    """
    keys = list(keys)
    index = lambda c, o: F.ceil((F.col(c) - o) / step - 0.5).cast("int")
    return (
        targets.withColumn("_i", index("lat", lat0))
        .withColumn("_j", index("lon", lon0))
        .join(_indexed(source, value, keys, lat0, lon0, step), [*keys, "_i", "_j"], "left")
        .drop("_i", "_j")
    )


def regrid_bilinear(
    source: DataFrame,
    targets: DataFrame,
    lat0: float,
    lon0: float,
    step: float,
    value: str = "value",
    keys: Sequence[str] = ("grid_id",),
) -> DataFrame:
    """Bilinear interpolation; NULL where a corner with weight is outside or missing.

    The source is gathered to one row per square with the values of its corners, so that a target is looked up once and is
    neither multiplied nor aggregated. A corner given several times counts with its mean.
    """
    keys = list(keys)
    sides = [(di, dj) for di in (0, 1) for dj in (0, 1)]
    corner = F.explode(F.array(*[F.struct(F.lit(di).alias("i"), F.lit(dj).alias("j")) for di, dj in sides]))
    squares = (
        _indexed(source, value, keys, lat0, lon0, step)
        .withColumn("_d", corner)
        .groupBy(*keys, (F.col("_i") - F.col("_d.i")).alias("_i"), (F.col("_j") - F.col("_d.j")).alias("_j"))
        .agg(
            *[
                F.avg(F.when((F.col("_d.i") == di) & (F.col("_d.j") == dj), F.col(value))).alias(f"_v{di}{dj}")
                for di, dj in sides
            ]
        )
    )
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")

    def part(di: int, dj: int) -> Column:
        w = (fy if di else 1 - fy) * (fx if dj else 1 - fx)
        return F.when(w > 1e-9, w * F.col(f"_v{di}{dj}")).otherwise(0.0)

    return (
        targets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select(*keys, "lat", "lon", ((F.col("lat") - lat0) / step).alias("_y"), ((F.col("lon") - lon0) / step).alias("_x"))
        .withColumn("_i", F.floor("_y").cast("int"))
        .withColumn("_j", F.floor("_x").cast("int"))
        .join(squares, [*keys, "_i", "_j"], "left")
        .select(*keys, "lat", "lon", reduce(add, [part(*side) for side in sides]).alias(value))
    )


def cell_rmse_components(cells: DataFrame, fc: str = "f", an: str = "a", clim: str = "c") -> DataFrame:
    """RMSE per cell and its three anomaly terms."""
    f, a = F.col(fc) - F.col(clim), F.col(an) - F.col(clim)
    return cells.groupBy(*CELL).agg(
        F.avg(f * f).alias("fc_variance"),
        F.avg(a * a).alias("an_variance"),
        F.avg(f * a).alias("covariance"),
        F.sqrt(F.avg(F.pow(F.col(fc) - F.col(an), F.lit(2)))).alias("rmse"),
    )


def cell_mae(cells: DataFrame, fc: str = "f", an: str = "a", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error per cell, optionally per season or another column."""
    return cells.groupBy(*CELL, *by).agg(F.avg(F.abs(F.col(fc) - F.col(an))).alias("mae"))


def cos_lat_mean(cells: DataFrame, value: str, by: Sequence[str] = ("grid_id", "time")) -> DataFrame:
    """cos(latitude)-weighted spatial mean."""
    w = F.when(F.col(value).isNotNull(), S.cos_latitude(F.col("lat")))
    return cells.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value)).where(F.col(value).isNotNull())


def with_time_index(cells: DataFrame, time: str = "time", name: str = "t") -> DataFrame:
    """0-based position of each row's time on the table's common time axis."""
    axis = with_row_number(cells.select(time).dropna().distinct(), [time], name="_rn")
    return cells.join(axis.select(time, (F.col("_rn") - 1).alias(name)), time)


def _line(rows: DataFrame, value: str, x: str, keys: Sequence[str]) -> DataFrame:
    y, t = F.col(value).cast("double"), F.col(x).cast("double")
    return rows.where(y.isNotNull()).groupBy(*keys).agg(
        F.regr_slope(y, t).alias("slope"),
        F.regr_intercept(y, t).alias("intercept"),
        F.regr_r2(y, t).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def linear_trend(series: DataFrame, value: str, x: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and r2."""
    return _line(series, value, x, list(keys))


def detrend(cells: DataFrame, value: str, x: str = "t", keys: Sequence[str] = CELL) -> DataFrame:
    """Residual (``detrended``) from the least-squares line of each cell; a single sample leaves 0."""
    keys = list(keys)
    line = _line(cells, value, x, keys).select(*keys, "slope", "intercept", F.col("n").alias("_n"))
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    residual = F.when(F.col("slope").isNull(), F.lit(0.0)).otherwise(F.col(value) - fitted)
    return (
        cells.where(F.col(value).isNotNull())
        .join(line, keys)
        .withColumn("detrended", residual)
        .drop("slope", "intercept", "_n")
    )


def marginal_means(cells: DataFrame, value: str = "value") -> DataFrame:
    """Means by lat, by time, by (time, lat) and overall in one pass; ``margin`` names the grouping."""
    gid = F.col("_gid")
    return (
        cells.groupingSets([["lat"], ["time"], ["time", "lat"], []], "time", "lat")
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("_gid"))
        .select(
            F.when(gid == 0, "time_lat").when(gid == 1, "time").when(gid == 2, "lat").otherwise("all").alias("margin"),
            "time",
            "lat",
            "mean",
            "n",
        )
    )


def reconstruction_rmse(cells: DataFrame, truth: str, rebuilt: str, by: Sequence[str] = ()) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col(truth) - F.col(rebuilt), F.lit(2)))).alias("rmse")
    )


def lat_profiles(cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean per time and latitude for every latitude of the data, with its position (from 0) on the axis."""
    axis = with_row_number(cells.select("lat").where(F.col("lat").isNotNull()).distinct(), ["lat"], name="_rn")
    means = cells.groupBy("time", "lat").agg(F.avg(value).alias(value))
    return means.join(axis, "lat").select("time", (F.col("_rn") - 1).cast("int").alias("lat_idx"), "lat", value)
