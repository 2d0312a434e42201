"""Calendar and time expressions. Every input is a TIMESTAMP_NTZ (naive UTC) or DATE column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First and last no-leap day of year of each season.
SEASON_DOY = {"MAM": (60, 151), "JJA": (152, 243), "SON": (244, 334)}


def is_leap_year(t: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366


def is_leap_day(t: Column) -> Column:
    return (F.month(t) == 2) & (F.dayofmonth(t) == 29)


def calendar_doy(t: Column) -> Column:
    """Day of year 1..366."""
    return F.dayofyear(t)


def noleap_doy(t: Column) -> Column:
    """Day of year 1..365; Feb 29 shares 60 with Mar 1."""
    shift = (is_leap_year(t) & (F.month(t) > 2)).cast("int")
    return (F.dayofyear(t) - shift).cast("int")


def valid_time(init: Column, lead_hours: Column) -> Column:
    return init + F.make_dt_interval(F.lit(0), lead_hours.cast("int"))


def init_time(valid: Column, lead_hours: Column) -> Column:
    return valid - F.make_dt_interval(F.lit(0), lead_hours.cast("int"))


def season_of_month(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .when(month.isin(9, 10, 11), "SON")
    )


def season_of_doy(doy: Column) -> Column:
    """Season of a no-leap day of year; everything outside spring..autumn is DJF."""
    expr = F.when(~doy.between(1, 365), F.lit(None).cast("string"))
    for name, (lo, hi) in SEASON_DOY.items():
        expr = expr.when(doy.between(lo, hi), name)
    return expr.otherwise("DJF")


def month_start(t: Column, offset: int = 0) -> Column:
    """First midnight of the month of ``t``, moved by ``offset`` months (DATE)."""
    return F.add_months(F.trunc(t, "month"), offset)


def extend_end(end: Column, max_lead_hours: int, last_init_hour: int = 12) -> Column:
    """Last valid time that forecasts started up to ``end`` can reach."""
    return end + F.make_dt_interval(F.lit(0), F.lit(last_init_hour + max_lead_hours))


def expected_days(year: Column, month: Column, drop_leap_day: bool = False) -> Column:
    first = F.make_date(year, month, F.lit(1))
    days = F.dayofmonth(F.last_day(first))
    if drop_leap_day:
        days = days - ((month == 2) & is_leap_year(first)).cast("int")
    return days.cast("int")


def day_number(t: Column) -> Column:
    """Days since 1970-01-01, without any time-zone conversion."""
    return F.unix_date(t.cast("date"))


def epoch_seconds(t: Column) -> Column:
    """Whole seconds since 1970-01-01 of a naive timestamp, without any time-zone conversion."""
    return (
        day_number(t).cast("long") * 86400
        + F.hour(t) * 3600
        + F.minute(t) * 60
        + F.floor(F.second(t))
    ).cast("long")


def time_axis(spark: SparkSession, start: str, end: str, step_hours: int, name: str = "time") -> DataFrame:
    """Every step from ``start`` to ``end`` inclusive, one row each."""
    return spark.range(1).select(
        F.explode(
            F.expr(
                f"sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{end}', INTERVAL '{step_hours}' HOUR)"
            )
        ).alias(name)
    )


def axis_of(df: DataFrame, time: str, step_hours: int) -> DataFrame:
    """Every step between the first and last value of ``time`` in ``df``, one row each."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL '{step_hours}' HOUR"))).alias(time))


def with_leads(df: DataFrame, leads: list[int], name: str = "lead_time") -> DataFrame:
    """Expand each row by the fixed lead list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in leads])))


def year_months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per month that overlaps [start, end]: year, month, first, last, n_days."""
    months = spark.range(1).select(
        F.explode(
            F.expr(f"sequence(trunc(DATE'{start}','month'), trunc(DATE'{end}','month'), INTERVAL 1 MONTH)")
        ).alias("m")
    )
    first = F.greatest(F.col("m"), F.lit(start).cast("date"))
    last = F.least(F.last_day("m"), F.lit(end).cast("date"))
    return months.select(
        F.year("m").alias("year"),
        F.month("m").alias("month"),
        first.alias("first"),
        last.alias("last"),
        (F.datediff(last, first) + 1).alias("n_days"),
    )
