"""File catalogues, calendars and alignment of forecasts with analyses.

A catalogue is a table of paths. Facts (init hour, lead, date) are read from the path text; calendars are
generated and joined by equality, so nothing is looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealcast.functions import timefn as T
from arealcast.functions.ids import file_date

# Init hour, lead, optional year and month folders, then the date in the file name.
FC_PATH = r"^.*?/(\d{4})/(\d+)/(?:\d{4}/\d{2}/)?[^/]*_(\d{8})(?:\D[^/]*)?\.{ext}$"
# Fixed value: month folder of a reanalysis path.
MONTH_FOLDER = r"/(\d{6})/[^/]+$"


def forecast_paths(files: DataFrame, path: str = "path", ext: str = "nc") -> DataFrame:
    """path, init_date, init_hour (text), lead_time and init_time of every forecast file that matches."""
    p = F.col(path)
    # One pattern match per path; a path that does not match stays whole and gives no three parts.
    parts = F.split(F.regexp_replace(p, FC_PATH.replace("{ext}", ext), "$1|$2|$3"), r"\|")
    return (
        files.select(p.alias("path"), parts.alias("_p"))
        .where(F.size("_p") == 3)
        .select(
            "path",
            F.try_to_date(F.get("_p", F.lit(2)), "yyyyMMdd").alias("init_date"),
            F.get("_p", F.lit(0)).alias("init_hour"),
            F.get("_p", F.lit(1)).cast("int").alias("lead_time"),
        )
        .where(F.col("init_date").isNotNull())
        .withColumn(
            "init_time",
            F.col("init_date").cast("timestamp_ntz")
            + F.make_dt_interval(
                F.lit(0), F.substring("init_hour", 1, 2).cast("int"), F.substring("init_hour", 3, 2).cast("int")
            ),
        )
    )


def analysis_paths(files: DataFrame, path: str = "path") -> DataFrame:
    return files.select(F.col(path).alias("path"), file_date(F.col(path)).alias("date")).dropna()


def forecast_catalogue(calendar: DataFrame, paths: DataFrame) -> DataFrame:
    """First matching file for each wanted (init_time, lead_time); slots without a file are skipped."""
    slots = paths.groupBy("init_time", "lead_time").agg(F.min("path").alias("path"))
    return calendar.select("init_time", "lead_time").join(slots, ["init_time", "lead_time"])


def analysis_catalogue(calendar: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per analysis time; a daily file serves every step of its day."""
    days = paths.groupBy("date").agg(F.min("path").alias("path"))
    return calendar.select("time", F.to_date("time").alias("date")).join(days, "date").select("time", "path")


def reanalysis_catalogue(calendar: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """One row per day except Feb 29, served by the first file of its month folder."""
    month = F.regexp_extract(path, MONTH_FOLDER, 1)
    monthly = files.groupBy(month.alias("_ym")).agg(F.min(path).alias("path"))
    days = calendar.where(~T.is_leap_day(F.col("time"))).withColumn("_ym", F.date_format("time", "yyyyMM"))
    return days.join(monthly, "_ym").select("time", "path")


def align(forecasts: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only entries whose valid time exists on the other side.

    ``forecasts`` has init_time and lead_time, ``analyses`` has time and path; of several analyses at one
    time the last path counts.
    """
    fc = forecasts.withColumn("valid_time", T.valid_time(F.col("init_time"), F.col("lead_time")))
    an = analyses.groupBy("time").agg(F.max("path").alias("path"))
    fc_kept = fc.join(an.select(F.col("time").alias("valid_time")), "valid_time", "left_semi")
    an_kept = an.join(fc.select(F.col("valid_time").alias("time")).distinct(), "time", "left_semi")
    return fc_kept, an_kept


def init_time_violations(rows: DataFrame) -> DataFrame:
    """Files whose rebuilt init time differs from the declared one or is not unique.

    ``rows`` has path, valid_time, lead_time and declared_init.
    """
    rebuilt = T.init_time(F.col("valid_time"), F.col("lead_time"))
    return (
        rows.withColumn("_init", rebuilt)
        .groupBy("path")
        .agg(
            F.min("_init").alias("first_init"),
            F.max("_init").alias("last_init"),
            F.max(F.col("_init") != F.col("declared_init")).alias("differs"),
        )
        .where(F.col("differs") | (F.col("first_init") != F.col("last_init")))
        .select("path", "first_init", "last_init", "differs")
    )


def grid_mismatches(cells: DataFrame, reference: DataFrame, file: str = "path") -> DataFrame:
    """Files whose cells differ from the reference's, with missing and extra cell counts.

    A cell is (grid_id, lat, lon) where both sides have ``grid_id``, else (lat, lon). Both sides are stacked and
    counted by key, so neither a cross join nor a whole file on one task is needed.
    """
    key = [c for c in ("grid_id", "lat", "lon") if c != "grid_id" or {c} <= set(cells.columns) & set(reference.columns)]
    ref = reference.select(*key).distinct()
    n_ref = ref.agg(F.count(F.lit(1))).scalar()
    seen = cells.select(file, *key).distinct()
    flagged = seen.join(ref.withColumn("_known", F.lit(1)), key, "left")
    return (
        flagged.groupBy(file)
        .agg(F.count("_known").alias("_common"), F.count_if(F.col("_known").isNull()).alias("n_extra"))
        .withColumn("n_missing", n_ref - F.col("_common"))
        .where((F.col("n_extra") > 0) | (F.col("n_missing") > 0))
        .select(file, "n_missing", "n_extra")
    )


def common_times(*tables: DataFrame, time: str = "time") -> DataFrame:
    """Distinct times present in every table."""
    # Distinct times meet, not rows, so a time with very many rows costs no more than any other.
    out = tables[0].select(time).distinct()
    for other in tables[1:]:
        out = out.join(other.select(time).distinct(), time, "left_semi")
    return out


def complete_dates(paths: DataFrame, init_hours: Sequence[str], leads: Sequence[int]) -> DataFrame:
    """Every date seen, the number of wanted (init hour, lead) pairs it has, and whether it has all."""
    wanted = F.col("init_hour").isin(list(init_hours)) & F.col("lead_time").isin(list(leads))
    need = len(init_hours) * len(leads)
    pairs = paths.select("init_date", "init_hour", "lead_time", wanted.alias("_w")).distinct()
    counted = pairs.groupBy("init_date").agg(F.count_if("_w").alias("n_pairs"))
    return counted.withColumn("complete", F.col("n_pairs") == need)


def missing_slots(calendar: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected slots without a found entry."""
    return calendar.select(*keys).join(found.select(*keys).distinct(), list(keys), "left_anti")


def chunk_key(df: DataFrame, time: str) -> DataFrame:
    """Add the year and month columns that name a chunk."""
    return df.withColumn("year", F.year(time)).withColumn("month", F.month(time))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the largest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_p")
    out = df.groupBy(*keys).agg(pick)
    return out.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])
