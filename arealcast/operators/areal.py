"""Grid values summarised over polygons through a weight table (grid_id, geo_id, lat, lon, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["grid_id", "lat", "lon"]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail when the scanned table lacks a variable or coordinate."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; have {df.columns}")
    return df


def area_weighted_mean(
    cells: DataFrame, weights: DataFrame, value: str = "value", by: Sequence[str] = ()
) -> DataFrame:
    """Weighted mean per polygon (and ``by``): missing cells are ignored, polygons without value dropped.

    The weight table is small next to the cells and is broadcast when its size allows; partial sums
    leave each task, so a polygon with many cells does not overload one reducer.
    """
    require_columns(cells, [*CELL, value, *by])
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return (
        cells.select(*CELL, *by, v.alias("_v"))
        .where(F.col("_v").isNotNull())
        .join(weights.select(*CELL, "geo_id", "w"), CELL)
        .groupBy("geo_id", *by)
        .agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias(value))
    )


def forecast_means(cells: DataFrame, weights: DataFrame, var: str = "t2m") -> DataFrame:
    """Polygon forecasts: cells carry valid_time and lead_time, init_time is derived."""
    out = area_weighted_mean(cells, weights, var, ["valid_time", "lead_time"])
    init = F.col("valid_time") - F.make_dt_interval(F.lit(0), F.col("lead_time").cast("int"))
    return out.withColumn("init_time", init).select("geo_id", "valid_time", "init_time", "lead_time", var)


def category_fractions(
    cells: DataFrame,
    weights: DataFrame,
    category: str = "category",
    by: Sequence[str] = (),
    ignore_missing: bool = False,
) -> DataFrame:
    """Share of each polygon's covered area per category.

    Cells without a category stay in the denominator unless ``ignore_missing``.
    """
    by = list(by)
    require_columns(cells, [*CELL, category, *by])
    rows = cells.select(*CELL, *by, category)
    if ignore_missing:
        rows = rows.where(F.col(category).isNotNull())
    sums = (
        rows.join(weights.select(*CELL, "geo_id", "w"), CELL)
        .groupBy("geo_id", *by, category)
        .agg(F.sum("w").alias("_w"))
    )
    # One row per polygon and category from here on.
    total = F.sum("_w").over(Window.partitionBy("geo_id", *by))
    return sums.withColumn("fraction", F.col("_w") / total).drop("_w")


def top_two(fractions: DataFrame, category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    """Largest and second-largest category per polygon; ties go to the higher category code.

    Shares are compared after rounding to nine digits, so the order of summation decides no tie.
    """
    rank = Window.partitionBy("geo_id", *by).orderBy(
        F.col(category).isNull(), F.desc("fraction"), F.desc(category)
    )
    at = lambda n, x: F.max(F.when((F.col("_r") == n) & F.col(category).isNotNull() & (F.col("fraction") > 0), x))
    pct = F.col("fraction") * 100
    return (
        fractions.withColumn("fraction", F.round("fraction", 9))
        .withColumn("_r", F.row_number().over(rank))
        .where(F.col("_r") <= 2)
        .groupBy("geo_id", *by)
        .agg(
            at(1, F.col(category)).alias("category_1"),
            F.coalesce(at(1, pct), F.lit(0.0)).alias("category_1_pct"),
            at(2, F.col(category)).alias("category_2"),
            F.coalesce(at(2, pct), F.lit(0.0)).alias("category_2_pct"),
        )
    )
