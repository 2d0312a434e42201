"""Registered queries: catalogues, alignment and completeness reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.functions import ids as I
from arealcast.functions import timefn as T
from arealcast.operators import align as AL
from arealcast.plans import quality as Q
from arealcast.plans.registry import Tables, query, rounded

LEADS = [24 * k for k in range(1, 8)]


def _fc_calendar(t: Tables) -> DataFrame:
    return T.with_leads(T.axis_of(AL.forecast_paths(t.files()), "init_time", 24), LEADS)


def _months(t: Tables) -> DataFrame:
    """Months of the data with the number of days in range."""
    days = T.axis_of(t.analyses().select("time"), "time", 24)
    return AL.chunk_key(days, "time").groupBy("year", "month").agg(F.count(F.lit(1)).cast("int").alias("n_days"))


@query
def file_dates(t: Tables) -> DataFrame:
    return AL.forecast_paths(t.files()).withColumn("init_date", F.col("init_date").cast("timestamp_ntz"))


@query
def forecast_catalogue(t: Tables) -> DataFrame:
    return AL.forecast_catalogue(_fc_calendar(t), AL.forecast_paths(t.files()))


@query
def analysis_catalogue(t: Tables) -> DataFrame:
    paths = AL.analysis_paths(t.analysis_files())
    steps = T.axis_of(paths.select(F.col("date").cast("timestamp_ntz").alias("time")), "time", 6)
    return AL.analysis_catalogue(steps, paths)


@query
def reanalysis_catalogue(t: Tables) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyyMM")
    files = t.raw("orders").select(
        F.concat(F.lit("/ra/"), month, F.lit("/e5_an_sfc_167_"), month, F.lit("0100.nc")).alias("path")
    ).distinct()
    days = T.axis_of(t.raw("orders").select(F.col("o_orderdate").alias("time")), "time", 24)
    return AL.reanalysis_catalogue(days, files)


def _aligned(t: Tables) -> tuple[DataFrame, DataFrame]:
    fc = AL.forecast_paths(t.files()).select("path", "init_time", "lead_time")
    an = AL.analysis_paths(t.analysis_files()).select("path", F.col("date").cast("timestamp_ntz").alias("time"))
    return AL.align(fc, an)


@query
def align_semi(t: Tables) -> DataFrame:
    return _aligned(t)[0].select("path", "init_time", "lead_time", "valid_time")


@query
def align_analyses(t: Tables) -> DataFrame:
    return _aligned(t)[1]


@query
def init_time_check(t: Tables) -> DataFrame:
    """Files that hold rows with a shifted valid time."""
    lead = F.col("l_linenumber") * 24
    init = F.col("l_shipdate")
    late = F.when(F.col("l_quantity") > 49, 6).otherwise(0)
    rows = t.raw("lineitem").select(
        F.concat_ws("_", F.date_format(init, "yyyyMMdd"), lead.cast("string")).alias("path"),
        (init + F.make_dt_interval(F.lit(0), lead + late)).alias("valid_time"),
        lead.alias("lead_time"),
        init.alias("declared_init"),
    )
    return AL.init_time_violations(rows)


@query
def grid_mismatches(t: Tables) -> DataFrame:
    files = t.cell_observations().withColumn("path", F.date_format("time", "yyyyMMdd"))
    return AL.grid_mismatches(files, t.cells().where(F.col("value").isNotNull()))


@query
def common_times(t: Tables) -> DataFrame:
    fc = t.forecasts().select(F.col("valid_time").alias("time"))
    second = t.forecasts(second=True).select(F.col("valid_time").alias("time"))
    return AL.common_times(fc, second, t.analyses())


@query
def distinct_leads(t: Tables) -> DataFrame:
    return t.forecasts().select("lead_time").distinct().orderBy("lead_time")


@query
def completeness_by_date(t: Tables) -> DataFrame:
    out = AL.complete_dates(AL.forecast_paths(t.files()), ["0000"], LEADS)
    return out.withColumn("init_date", F.col("init_date").cast("timestamp_ntz"))


@query
def missing_slots(t: Tables) -> DataFrame:
    return AL.missing_slots(_fc_calendar(t), AL.forecast_paths(t.files()), ["init_time", "lead_time"])


def _days_on_disk(t: Tables) -> DataFrame:
    """Days with an order play the analysis days on disk."""
    return AL.chunk_key(t.raw("orders").select("o_orderdate").distinct(), "o_orderdate")


def _wanted_days(t: Tables) -> DataFrame:
    """Days that forecasts are valid on; an analysis is wanted for each."""
    return T.axis_of(t.forecasts().select(F.col("valid_time").alias("o_orderdate")), "o_orderdate", 24)


def _wanted_months(t: Tables) -> DataFrame:
    days = AL.chunk_key(_wanted_days(t), "o_orderdate")
    return days.groupBy("year", "month").agg(F.count(F.lit(1)).cast("int").alias("n_days"))


def _analysis_completeness(t: Tables) -> DataFrame:
    expected = _wanted_months(t).select("year", "month", F.col("n_days").alias("n_expected"))
    files = _days_on_disk(t).withColumn("corrupt", F.lit(False))
    return Q.source_completeness(expected, files, ["year", "month"])


@query
def source_completeness(t: Tables) -> DataFrame:
    """Folders of the forecast tree (init month and lead); a file with a record at full tax is corrupt."""
    months = _months(t)
    expected = T.with_leads(months, LEADS).select("year", "month", "lead_time", F.col("n_days").alias("n_expected"))
    files = AL.chunk_key(
        t.raw("lineitem")
        .groupBy("l_shipdate", (F.col("l_linenumber") * 24).alias("lead_time"))
        .agg((F.max("l_tax") >= 0.08).alias("corrupt")),
        "l_shipdate",
    )
    return Q.source_completeness(expected, files, ["year", "month", "lead_time"])


@query
def gap_report(t: Tables) -> DataFrame:
    return Q.gap_report(_analysis_completeness(t), (1998, 1))


@query
def gap_details(t: Tables) -> DataFrame:
    return Q.first_details(Q.gap_report(_analysis_completeness(t), (1998, 1)), ["year", "month"], 20)


@query
def missing_dates(t: Tables) -> DataFrame:
    return AL.missing_slots(_wanted_days(t), _days_on_disk(t), ["o_orderdate"])


@query
def daily_staleness(t: Tables) -> DataFrame:
    daily = t.analyses().where(~T.is_leap_day(F.col("time"))).select("time")
    return Q.daily_staleness(daily, _months(t))


@query
def chunk_completeness(t: Tables) -> DataFrame:
    fc = AL.chunk_key(t.forecasts(), "init_time")
    expected = Q.expected_forecast_chunks(_months(t), LEADS)
    return Q.chunk_completeness(expected, fc, ["year", "month", "lead_time"], "valid_time")


@query
def analysis_chunk_completeness(t: Tables) -> DataFrame:
    an = AL.chunk_key(t.cell_observations().select("time"), "time")
    return Q.chunk_completeness(Q.expected_analysis_chunks(_months(t)), an, ["year", "month"], "time")


@query
def clim_check(t: Tables) -> DataFrame:
    return Q.climatology_check(t.climatology())


@query
def cleanup_plan(t: Tables) -> DataFrame:
    daily = t.raw("orders").select(F.col("o_orderdate").alias("time")).distinct()
    fc = AL.chunk_key(t.forecasts(), "init_time")
    chunks = Q.chunk_completeness(
        Q.expected_forecast_chunks(_months(t), LEADS, 1), fc, ["year", "month", "lead_time"], "valid_time"
    )
    daily = Q.daily_staleness(daily, _wanted_months(t))
    return Q.cleanup_plan(chunks, daily, Q.climatology_check(t.climatology()))


@query
def table_presence(t: Tables) -> DataFrame:
    return Q.table_presence({"bias": t.bias(), "second_bias": t.bias(second=True), "koppen": None, "census": t.census()})


@query
def chunk_groups(t: Tables) -> DataFrame:
    """Catalogue entries per (lead, init year, init month)."""
    paths = AL.chunk_key(AL.forecast_paths(t.files()), "init_time")
    return paths.groupBy("lead_time", "year", "month").agg(F.count(F.lit(1)).alias("n_files"))


@query
def chunk_names(t: Tables) -> DataFrame:
    """Chunk file names built from the data and parsed back."""
    groups = chunk_groups(t)
    name = F.format_string("ifs_fc_2t_county_%d_%02d_lead%03d.parquet", "year", "month", "lead_time")
    return groups.select(name.alias("name")).select("name", *I.chunk_parts(F.col("name")))


@query
def expected_calendar(t: Tables) -> DataFrame:
    """Wanted (init, lead, valid) slots, two starts per day."""
    span = t.forecasts().select("init_time")
    slots = T.with_leads(T.axis_of(span, "init_time", 12), LEADS)
    return slots.withColumn("valid_time", T.valid_time(F.col("init_time"), F.col("lead_time")))


@query
def stream_states(t: Tables) -> DataFrame:
    """Tagged stack of both forecast streams and the analysis, counted per stream and month."""
    tag = lambda df, time, name: df.select(F.lit(name).alias("stream"), F.col(time).alias("time"))
    rows = (
        tag(t.forecasts(), "init_time", "ifs_fc")
        .unionByName(tag(t.forecasts(second=True), "init_time", "aifs_fc"))
        .unionByName(tag(t.analyses(), "time", "ifs_an"))
    )
    return AL.chunk_key(rows, "time").groupBy("stream", "year", "month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("time").alias("n_times")
    )
