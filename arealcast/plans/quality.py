"""Completeness and health reports of source files and produced tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.functions import timefn as T
from arealcast.operators.align import chunk_key

# Smallest plausible gridded file, leading bytes of the accepted formats, report length,
# columns a climatology must have, and the day range it must cover.
MIN_FILE_BYTES = 10_000
MAGIC = {"netcdf3": b"CDF", "hdf5": b"\x89HDF"}
CLIMATOLOGY_COLUMNS = ("t2m_clim", "geo_id", "day_of_year")
DOY_RANGE = (1, 365)


def file_suspects(files: DataFrame, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """Flag files that are too small or start with the wrong bytes.

    ``files``: path, length and head, the leading bytes, as ``sources.files.file_heads`` gives them. A file shorter than
    a signature does not begin with it.
    """
    right_kind = F.lit(False)
    for magic in MAGIC.values():
        right_kind = right_kind | (F.substring("head", 1, len(magic)) == F.lit(magic))
    return files.select(
        "path",
        "length",
        (F.col("length") < min_bytes).alias("too_small"),
        (~right_kind).alias("wrong_magic"),
    ).withColumn("suspect", F.col("too_small") | F.col("wrong_magic"))


def source_completeness(expected: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files found against files expected per folder key.

    ``expected``: keys plus n_expected. ``files``: keys plus corrupt (boolean), one row per file.
    Status is MISSING without any file, CORRUPT with a bad file, INCOMPLETE when the number of files
    differs from the expected one, else OK.
    """
    keys = list(keys)
    found = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_found"), F.count_if("corrupt").alias("n_corrupt")
    )
    n = F.coalesce("n_found", F.lit(0))
    bad = F.coalesce("n_corrupt", F.lit(0))
    status = (
        F.when(n == 0, "MISSING")
        .when(bad > 0, "CORRUPT")
        .when(n != F.col("n_expected"), "INCOMPLETE")
        .otherwise("OK")
    )
    return expected.join(found, keys, "left").select(
        *keys, "n_expected", n.alias("n_found"), bad.alias("n_corrupt"), status.alias("status")
    )


def gap_report(completeness: DataFrame, second_start: tuple[int, int]) -> DataFrame:
    """Months with fewer analysis days than expected, and whether the second model is affected too."""
    missing = F.col("n_expected") - F.col("n_found")
    month_no = F.col("year") * 12 + F.col("month")
    return completeness.where(missing > 0).select(
        "year",
        "month",
        missing.alias("n_missing"),
        (month_no >= second_start[0] * 12 + second_start[1]).alias("affects_second"),
    )


def daily_staleness(daily: DataFrame, months: DataFrame, time: str = "time") -> DataFrame:
    """OK, STALE or MISSING per month: distinct days against the calendar without Feb 29."""
    days = (
        chunk_key(daily.select(time).distinct(), time)
        .groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("n_days"))
    )
    expected = T.expected_days(F.col("year"), F.col("month"), drop_leap_day=True)
    joined = months.select("year", "month").join(days, ["year", "month"], "left")
    n = F.coalesce("n_days", F.lit(0))
    return joined.select(
        "year",
        "month",
        n.alias("n_days"),
        expected.alias("n_expected"),
        F.when(n == 0, "MISSING").when(n != expected, "STALE").otherwise("OK").alias("status"),
    )


def climatology_check(clim: DataFrame) -> DataFrame:
    """One row: day range, distinct days, missing columns and OK / PARTIAL."""
    missing = [c for c in CLIMATOLOGY_COLUMNS if c not in clim.columns]
    lost = F.lit(",".join(missing))
    if "day_of_year" in missing:
        return clim.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows",
            *[F.lit(None).cast("int").alias(c) for c in ("doy_min", "doy_max")],
            F.lit(0).cast("long").alias("n_doys"),
            lost.alias("missing_columns"),
            F.lit("PARTIAL").alias("status"),
        )
    out = clim.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("day_of_year").alias("doy_min"),
        F.max("day_of_year").alias("doy_max"),
        F.count_distinct("day_of_year").alias("n_doys"),
    )
    lo, hi = DOY_RANGE
    full = (F.col("doy_min") == lo) & (F.col("doy_max") == hi) & (F.col("n_doys") == hi)
    ok = full if not missing else F.lit(False)
    return out.withColumn("missing_columns", lost).withColumn("status", F.when(ok, "OK").otherwise("PARTIAL"))


def chunk_completeness(
    expected: DataFrame, table: DataFrame, keys: Sequence[str], time: str
) -> DataFrame:
    """Distinct times of each chunk against ``expected`` (keys plus n_expected): OK, INCOMPLETE, MISSING."""
    keys = list(keys)
    found = table.select(*keys, time).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_times"))
    n = F.coalesce("n_times", F.lit(0))
    status = F.when(n == 0, "MISSING").when(n < F.col("n_expected"), "INCOMPLETE").otherwise("OK")
    return expected.join(found, keys, "left").select(
        *keys, "n_expected", n.alias("n_times"), status.alias("status")
    )


def expected_forecast_chunks(months: DataFrame, leads: Sequence[int], inits_per_day: int = 2) -> DataFrame:
    """Every (init month, lead) chunk; whole months always count, as both inits of the last day are kept."""
    days = T.expected_days(F.col("year"), F.col("month"))
    return T.with_leads(months, list(leads)).select(
        "year", "month", "lead_time", (days * inits_per_day).alias("n_expected")
    )


def expected_analysis_chunks(months: DataFrame, steps_per_day: int = 4) -> DataFrame:
    return months.select("year", "month", (F.col("n_days") * steps_per_day).alias("n_expected"))


def table_presence(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per named table; NULL and MISSING where a table is absent."""
    parts = []
    spark = next(df for df in tables.values() if df is not None).sparkSession
    for name, df in tables.items():
        if df is None:
            parts.append(
                spark.range(1).select(
                    F.lit(name).alias("table"), F.lit(None).cast("long").alias("n_rows"), F.lit("MISSING").alias("status")
                )
            )
        else:
            parts.append(
                df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                    F.lit(name).alias("table"), "n_rows", F.lit("OK").alias("status")
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_details(report: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` report lines with the number of lines beyond them (``n_more``)."""
    total: Column = report.agg(F.count(F.lit(1))).scalar()
    more = F.greatest(total - n, F.lit(0).cast("long"))
    return report.orderBy(*order).limit(n).withColumn("n_more", more)


def cleanup_plan(
    chunk_report: DataFrame, daily_report: DataFrame, clim_status: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """What a cleanup would delete: kind, year, month, lead_time, path, reason.

    Incomplete and stale partitions, corrupt files, and the climatology only when it is not OK and at
    least one month is flagged. Deleting is left to ``sources.chunks.drop_partitions``.
    """
    none = F.lit(None)
    fc = chunk_report.where(F.col("status") == "INCOMPLETE").select(
        F.lit("chunk").alias("kind"),
        "year",
        "month",
        (F.col("lead_time") if "lead_time" in chunk_report.columns else none.cast("int")).alias("lead_time"),
        none.cast("string").alias("path"),
        F.concat(F.lit("INCOMPLETE "), F.col("n_times"), F.lit("/"), F.col("n_expected")).alias("reason"),
    )
    flagged = daily_report.where(F.col("status") != "OK")
    months = flagged.where(F.col("status") == "STALE").select(
        F.lit("daily").alias("kind"),
        "year",
        "month",
        none.cast("int").alias("lead_time"),
        none.cast("string").alias("path"),
        F.concat(F.lit("STALE "), F.col("n_days"), F.lit("/"), F.col("n_expected")).alias("reason"),
    )
    n_flagged = flagged.agg(F.count(F.lit(1))).scalar()
    clim = clim_status.where((F.col("status") != "OK") & (n_flagged > 0)).select(
        F.lit("climatology").alias("kind"),
        none.cast("int").alias("year"),
        none.cast("int").alias("month"),
        none.cast("int").alias("lead_time"),
        none.cast("string").alias("path"),
        F.lit("PARTIAL").alias("reason"),
    )
    out = fc.unionByName(months).unionByName(clim)
    if files is not None:
        out = out.unionByName(
            files.where("suspect").select(
                F.lit("file").alias("kind"),
                none.cast("int").alias("year"),
                none.cast("int").alias("month"),
                none.cast("int").alias("lead_time"),
                "path",
                F.lit("CORRUPT").alias("reason"),
            )
        )
    return out
