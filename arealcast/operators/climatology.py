"""Day-of-year climatologies and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.functions import timefn as T


def drop_leap_days(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(~T.is_leap_day(F.col(time)))


def daily_mean(cells: DataFrame, value: str = "value", keys: Sequence[str] = ("grid_id", "lat", "lon")) -> DataFrame:
    """Mean over the hours of each day per cell, missing values skipped."""
    return (
        cells.withColumn("day", F.to_date("time"))
        .groupBy(*keys, "day")
        .agg(F.avg(value).alias(value))
        .where(F.col(value).isNotNull())
        .withColumn("time", F.col("day").cast("timestamp_ntz"))
        .drop("day")
    )


def partial_climatology(daily: DataFrame, var: str = "t2m") -> DataFrame:
    """Mergeable state: sum and count per area and no-leap day of year."""
    return (
        daily.withColumn("day_of_year", T.noleap_doy(F.col("time")))
        .groupBy("geo_id", "day_of_year")
        .agg(F.sum(var).alias("sum"), F.count(var).alias("count"))
    )


def merge_partials(states: DataFrame) -> DataFrame:
    """Sums and counts of several states as one."""
    return states.groupBy("geo_id", "day_of_year").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def merge_climatology(states: DataFrame, var: str = "t2m") -> DataFrame:
    """Climatology from any number of partial states stacked in one table."""
    return (
        merge_partials(states)
        .select("geo_id", "day_of_year", F.try_divide("sum", "count").alias(f"{var}_clim"))
    )


def climatology(daily: DataFrame, var: str = "t2m") -> DataFrame:
    """Mean per area and no-leap day of year."""
    return (
        daily.withColumn("day_of_year", T.noleap_doy(F.col("time")))
        .groupBy("geo_id", "day_of_year")
        .agg(F.avg(var).alias(f"{var}_clim"))
    )


def seasonal_means(clim: DataFrame, var: str = "t2m") -> DataFrame:
    """Annual and seasonal means per area in one pass, in degrees Celsius."""
    celsius = F.col(f"{var}_clim") - 273.15
    return (
        clim.select("geo_id", T.season_of_doy(F.col("day_of_year")).alias("season"), celsius.alias("_c"))
        .groupingSets([["geo_id", "season"], ["geo_id"]], "geo_id", "season")
        .agg(F.avg("_c").alias(f"{var}_c"), F.grouping("season").alias("_all"))
        .select(
            "geo_id",
            F.when(F.col("_all") == 1, "annual").otherwise(F.col("season")).alias("season"),
            f"{var}_c",
        )
    )


def remove_doy_mean(series: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the day-of-year mean of ``value`` (``doy_mean``) and the departure from it (``doy_anom``)."""
    keys = list(keys)
    tagged = series.withColumn("day_of_year", T.noleap_doy(F.col("time")))
    means = tagged.groupBy(*keys, "day_of_year").agg(F.avg(value).alias("doy_mean"))
    return tagged.join(means, [*keys, "day_of_year"]).withColumn(
        "doy_anom", F.col(value) - F.col("doy_mean")
    )


def grid_climatology_anomaly(
    cells: DataFrame, clim: DataFrame, value: str = "value", clim_value: str = "clim"
) -> DataFrame:
    """Cell anomaly from a gridded climatology looked up by no-leap day of year."""
    keys = ["grid_id", "lat", "lon", "day_of_year"]
    return (
        cells.withColumn("day_of_year", T.noleap_doy(F.col("time")))
        .join(clim.select(*keys, clim_value), keys)
        .withColumn("anom", F.col(value) - F.col(clim_value))
    )
