"""Forecast against analysis, climatology and the other model; skill summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.functions import timefn as T
from arealcast.functions.ids import keep_present
from arealcast.operators.moments import weighted_moments

# Column order of the derived tables, for variable name {v}.
BIAS_COLUMNS = [
    "geo_id", "valid_time", "init_time", "lead_time", "{v}_fc", "{v}_an", "bias", "abs_error", "aland",
]
ANOMALY_COLUMNS = [*BIAS_COLUMNS, "day_of_year", "{v}_clim", "fc_anom", "an_anom"]

MONTHS = list(range(1, 13))
# A spread up to this share of the values' size is rounding noise of a constant, in whatever unit.
FLAT = 1e-12


def named(columns: Sequence[str], var: str) -> list[str]:
    return [c.replace("{v}", var) for c in columns]


def bias_table(fc: DataFrame, an: DataFrame, area: DataFrame | None = None, var: str = "t2m") -> DataFrame:
    """Inner join of forecasts with analyses at the valid time, with bias and absolute error.

    ``area`` (geo_id, aland) is attached by a left join. No join is hinted: the optimizer broadcasts the
    analysis or area side when its size allows and otherwise shuffles on the keys, splitting hot ones.
    """
    truth = an.select("geo_id", F.col("time").alias("valid_time"), F.col(var).alias(f"{var}_an"))
    out = (
        fc.withColumnRenamed(var, f"{var}_fc")
        .join(truth, ["geo_id", "valid_time"])
        .withColumn("bias", S.bias(F.col(f"{var}_fc"), F.col(f"{var}_an")))
        .withColumn("abs_error", F.abs("bias"))
    )
    if area is not None:
        out = out.join(area.select("geo_id", "aland"), "geo_id", "left")
    return keep_present(out, named(BIAS_COLUMNS, var))


def anomaly_table(bias: DataFrame, clim: DataFrame, var: str = "t2m") -> DataFrame:
    """Inner join with the day-of-year climatology; rows without climatology vanish."""
    doy = T.noleap_doy(F.col("valid_time"))
    out = (
        bias.withColumn("day_of_year", doy)
        .join(clim.select("geo_id", "day_of_year", f"{var}_clim"), ["geo_id", "day_of_year"])
        .withColumn("fc_anom", F.col(f"{var}_fc") - F.col(f"{var}_clim"))
        .withColumn("an_anom", F.col(f"{var}_an") - F.col(f"{var}_clim"))
    )
    return keep_present(out, named(ANOMALY_COLUMNS, var))


def model_comparison(
    first: DataFrame,
    second: DataFrame,
    area: DataFrame | None = None,
    names: tuple[str, str] = ("ifs", "aifs"),
) -> DataFrame:
    """Join two bias tables on area, valid time and lead; differences are second minus first."""
    keys = ["geo_id", "valid_time", "lead_time"]
    a, b = names

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *keys, F.col("bias").alias(f"bias_{name}"), F.col("abs_error").alias(f"abs_error_{name}")
        )

    out = (
        side(first, a)
        .join(side(second, b), keys)
        .withColumn("bias_diff", F.col(f"bias_{b}") - F.col(f"bias_{a}"))
        .withColumn("abs_error_diff", F.col(f"abs_error_{b}") - F.col(f"abs_error_{a}"))
    )
    if area is not None:
        out = out.join(area.select("geo_id", "aland"), "geo_id", "left")
    return out


def compare_forecasts(
    first: DataFrame,
    second: DataFrame,
    an: DataFrame,
    area: DataFrame | None = None,
    names: tuple[str, str] = ("ifs", "aifs"),
    var: str = "t2m",
) -> DataFrame:
    """``model_comparison`` straight from the forecasts of two models: they meet first, and the analyses are joined once."""
    keys = ["geo_id", "valid_time", "lead_time"]
    pair = first.select(*keys, F.col(var).alias("_a")).join(second.select(*keys, F.col(var).alias("_b")), keys)
    truth = an.select("geo_id", F.col("time").alias("valid_time"), F.col(var).alias("_an"))
    out = pair.join(truth, ["geo_id", "valid_time"])
    for name, side in zip(names, ("_a", "_b")):
        out = out.withColumn(f"bias_{name}", S.bias(F.col(side), F.col("_an"))).withColumn(f"abs_error_{name}", F.abs(f"bias_{name}"))
    a, b = names
    out = out.withColumn("bias_diff", F.col(f"bias_{b}") - F.col(f"bias_{a}"))
    out = out.withColumn("abs_error_diff", F.col(f"abs_error_{b}") - F.col(f"abs_error_{a}")).drop("_a", "_b", "_an")
    columns = [*keys, *[f"{c}_{n}" for n in names for c in ("bias", "abs_error")], "bias_diff", "abs_error_diff"]
    out = out.select(*columns)
    return out if area is None else out.join(area.select("geo_id", "aland"), "geo_id", "left")


def filter_bias(
    bias: DataFrame,
    lead_times: Sequence[int] = (),
    start: str | None = None,
    end: str | None = None,
    geo_ids: Sequence[str] = (),
) -> DataFrame:
    """Conjunction of the given filters; an empty list or None does not filter.

    A bare end date is midnight, so only the first instant of that day is kept.
    """
    if lead_times:
        bias = bias.where(F.col("lead_time").isin(list(lead_times)))
    if start:
        bias = bias.where(F.col("valid_time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bias = bias.where(F.col("valid_time") <= F.lit(end).cast("timestamp_ntz"))
    if geo_ids:
        bias = bias.where(F.col("geo_id").isin(list(geo_ids)))
    return bias


def spill_over_month(fc: DataFrame, year: int, month: int, max_lead_hours: int) -> DataFrame:
    """Forecasts valid in one month, from every init month that can reach it.

    The implied range of init months is added as a predicate so that only those partitions are read.
    """
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start, stop = first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")
    out = fc.where((F.col("valid_time") >= start) & (F.col("valid_time") < stop))
    if {"year", "month"} <= set(fc.columns):
        lead_months = -(-max_lead_hours // (28 * 24))
        month_no = F.col("year") * 12 + F.col("month")
        this = year * 12 + month
        years = sorted({(this - k - 1) // 12 for k in range(lead_months + 1)})
        out = out.where(F.col("year").isin(years) & month_no.between(this - lead_months, this))
    return out


def skill_aggregates(weight: Column | None = None) -> list[Column]:
    """Mean bias, RMSE, MAE and row count, plain or weighted."""
    if weight is None:
        mean = lambda x: F.avg(x)
    else:
        total = F.sum(F.when(F.col("bias").isNotNull(), weight))
        mean = lambda x: F.try_divide(F.sum(weight * x), total)
    b, e = F.col("bias"), F.col("abs_error")
    return [
        mean(b).alias("mean_bias"),
        F.sqrt(mean(b * b)).alias("rmse"),
        mean(e).alias("mae"),
        F.count(F.lit(1)).alias("n_obs"),
    ]


def skill_summary(bias: DataFrame, by: Sequence[str] = ("geo_id", "lead_time")) -> DataFrame:
    return bias.groupBy(*by).agg(*skill_aggregates())


def skill_by_lead(models: dict[str, DataFrame], area_weighted: bool = False) -> DataFrame:
    """Skill of every model by lead time; ``area_weighted`` weights rows by ``aland``."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in models.items()]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df)
    weight = F.col("aland") if area_weighted else None
    if area_weighted:
        both = both.where(F.col("aland").isNotNull())
    return both.groupBy("model", "lead_time").agg(*skill_aggregates(weight))


def mean_by_month_lead(df: DataFrame, columns: Sequence[str], area_weighted: bool = False) -> DataFrame:
    """Mean of each column by month of the valid time and lead time, as ``mean_<column>``."""
    if area_weighted:
        df = df.where(F.col("aland").isNotNull())

    def mean(c: str) -> Column:
        if not area_weighted:
            return F.avg(c)
        w = F.when(F.col(c).isNotNull(), F.col("aland"))
        return F.try_divide(F.sum(w * F.col(c)), F.sum(w))

    return (
        df.withColumn("month", F.month("valid_time"))
        .groupBy("month", "lead_time")
        .agg(*[mean(c).alias(f"mean_{c}") for c in columns])
    )


def pivot_months(by_month: DataFrame, value: str) -> DataFrame:
    """One row per lead time with a column per month (``m01`` .. ``m12``)."""
    cells = [
        F.max(F.when(F.col("month") == m, F.col(value))).alias(f"m{m:02d}") for m in MONTHS
    ]
    return by_month.groupBy("lead_time").agg(*cells)


def area_mean_bias(bias: DataFrame, lead: int, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        filter_bias(bias, [lead], start, end)
        .groupBy("geo_id")
        .agg(F.avg("bias").alias("mean_bias"))
    )


def mean_of_area_means(summary: DataFrame) -> DataFrame:
    """Unweighted mean over areas of the per-area statistics, by lead time."""
    return summary.groupBy("lead_time").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("mean_bias", "rmse", "mae")],
        F.count(F.lit(1)).alias("n_areas"),
    )


def doy_lead_bias(bias: DataFrame) -> DataFrame:
    """Mean bias by area, lead time and calendar day of year (1..366)."""
    return (
        bias.withColumn("day_of_year", T.calendar_doy(F.col("valid_time")))
        .groupBy("geo_id", "lead_time", "day_of_year")
        .agg(F.avg("bias").alias("mean_bias"), F.count(F.lit(1)).alias("n_obs"))
    )


def anomaly_correlation(
    df: DataFrame, x: str, y: str, weight: str, by: Sequence[str] = ("valid_time",)
) -> DataFrame:
    """Weighted, centred correlation per group; NULL when either side is constant.

    One pass over the rows: their moments are merged around common means, so values far from zero do not cancel.
    """
    by = list(by)
    m = F.col("m")
    flat = lambda lo, hi: m[hi] - m[lo] <= FLAT * F.greatest(F.abs(m[hi]), F.abs(m[lo]))
    acc = F.try_divide(m["sxy"], F.sqrt(m["sxx"] * m["syy"]))
    found = weighted_moments(df, x, y, weight, by)
    return found.select(*by, F.when(~(flat("x0", "x1") | flat("y0", "y1")), acc).alias("acc"), m["n"].alias("n_areas"))


def symmetric_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Largest absolute value, and joint minimum and maximum, over several columns."""
    return df.agg(
        F.greatest(*[F.max(F.abs(F.col(c))) for c in columns]).alias("max_abs"),
        F.least(*[F.min(c) for c in columns]).alias("joint_min"),
        F.greatest(*[F.max(c) for c in columns]).alias("joint_max"),
    )
