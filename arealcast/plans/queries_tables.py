"""Registered queries over forecast, analysis and climatology tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.functions import timefn as T
from arealcast.operators import asof as A
from arealcast.operators import climatology as C
from arealcast.operators import verify as V
from arealcast.plans.registry import Tables, query, rounded
from arealcast.session import shared_dir
from arealcast.sources import chunks as CH
from arealcast.streaming.incremental import climatology_from_state, climatology_state, new_chunks


@query
def summary_stats(t: Tables) -> DataFrame:
    return rounded(V.skill_summary(t.bias()).orderBy("geo_id", "lead_time"))


@query
def bias_table(t: Tables) -> DataFrame:
    return rounded(t.bias())


@query
def query_bias_filtered(t: Tables) -> DataFrame:
    return rounded(
        V.filter_bias(t.bias(), [24, 72], "1997-01-01", "1999-12-31", ["00001", "00003", "00007"])
    )


@query
def anomaly_table(t: Tables) -> DataFrame:
    return rounded(t.anomalies())


@query
def climatology(t: Tables) -> DataFrame:
    return rounded(t.climatology())


@query
def climatology_incremental(t: Tables) -> DataFrame:
    """One partial state per year of data, merged afterwards."""
    daily = C.drop_leap_days(t.analyses())
    states = (
        daily.withColumn("year", F.year("time"))
        .withColumn("day_of_year", T.noleap_doy(F.col("time")))
        .groupBy("year", "geo_id", "day_of_year")
        .agg(F.sum("t2m").alias("sum"), F.count("t2m").alias("count"))
    )
    return rounded(C.merge_climatology(states))


@query
def daily_series_without_leap_days(t: Tables) -> DataFrame:
    return rounded(
        C.drop_leap_days(t.analyses()).withColumn("day_of_year", T.noleap_doy(F.col("time")))
    )


@query
def model_comparison(t: Tables) -> DataFrame:
    return rounded(V.compare_forecasts(t.forecasts(), t.forecasts(second=True), t.analyses(), t.land_area()))


@query
def spill_over_month(t: Tables) -> DataFrame:
    fc = t.forecasts()
    chunked = fc.withColumn("year", F.year("init_time")).withColumn("month", F.month("init_time"))
    return rounded(V.spill_over_month(chunked, 1998, 3, 168))


@query
def stored_chunks(t: Tables) -> DataFrame:
    """Forecast chunks written in two runs, the second only adding what the first left out.

    Which chunks there are is told by the forecasts' starts and leads, so the forecasts themselves are only made for the
    chunks to build.
    """
    path = shared_dir(t.spark, "chunks")
    fc, slots = t.forecasts(), t.forecast_slots()
    early = F.year("init_time") < 1998
    CH.resume(fc.where(early), path, "fc", catalogue=CH.with_chunk_columns(slots.where(early), "fc").drop("init_time"))
    CH.resume(fc, path, "fc", catalogue=CH.with_chunk_columns(slots, "fc").drop("init_time"))
    return rounded(t.spark.read.parquet(path))


@query
def streamed_chunks(t: Tables) -> DataFrame:
    """Analysis chunks kept up to date by a file stream."""
    source, target, checkpoint = (shared_dir(t.spark, f"an-{n}") for n in ("source", "target", "checkpoint"))
    t.analyses().write.parquet(source)
    new_chunks(
        t.spark, source, "geo_id string, time timestamp_ntz, t2m double", target, checkpoint, "an"
    ).awaitTermination()
    return rounded(t.spark.read.parquet(target))


@query
def skill_by_lead(t: Tables) -> DataFrame:
    return rounded(V.skill_by_lead({"ifs": t.bias(), "aifs": t.bias(second=True)}))


@query
def skill_by_lead_area_weighted(t: Tables) -> DataFrame:
    return rounded(V.skill_by_lead({"ifs": t.bias(), "aifs": t.bias(second=True)}, area_weighted=True))


@query
def bias_month_lead(t: Tables) -> DataFrame:
    return rounded(V.mean_by_month_lead(t.bias(), ["bias"]).orderBy("month", "lead_time"))


@query
def bias_month_lead_pivot(t: Tables) -> DataFrame:
    return rounded(V.pivot_months(V.mean_by_month_lead(t.bias(), ["bias"]), "mean_bias"))


@query
def anom_month_lead(t: Tables) -> DataFrame:
    return rounded(V.mean_by_month_lead(t.anomalies(), ["fc_anom", "an_anom"]))


@query
def anom_month_lead_area_weighted(t: Tables) -> DataFrame:
    return rounded(V.mean_by_month_lead(t.anomalies(), ["fc_anom", "an_anom"], area_weighted=True))


@query
def county_mean_bias(t: Tables) -> DataFrame:
    return rounded(V.area_mean_bias(t.bias(), 48, "1996-01-01", "2000-12-31"))


@query
def mean_of_means(t: Tables) -> DataFrame:
    return rounded(V.mean_of_area_means(V.skill_summary(t.bias())))


@query
def doy_lead_bias(t: Tables) -> DataFrame:
    return rounded(V.doy_lead_bias(t.bias()))


@query
def weighted_acc(t: Tables) -> DataFrame:
    return rounded(V.anomaly_correlation(t.anomalies(), "fc_anom", "an_anom", "aland"))


@query
def seasonal_climatology(t: Tables) -> DataFrame:
    return rounded(C.seasonal_means(t.climatology()))


@query
def doy_anomaly(t: Tables) -> DataFrame:
    errors = t.bias().groupBy(F.col("valid_time").alias("time")).agg(F.avg("abs_error").alias("mae"))
    return rounded(C.remove_doy_mean(errors, "mae"))


@query
def anomaly_range(t: Tables) -> DataFrame:
    return rounded(V.symmetric_range(t.anomalies(), ["fc_anom", "an_anom"]))


@query
def celsius_columns(t: Tables) -> DataFrame:
    bias = t.bias()
    return rounded(
        bias.select(
            "geo_id",
            "valid_time",
            "lead_time",
            S.kelvin_to_celsius(F.col("t2m_fc")).alias("t2m_fc_c"),
            S.kelvin_to_celsius(F.col("t2m_an")).alias("t2m_an_c"),
            S.safe_ln(F.col("abs_error")).alias("ln_abs_error"),
        )
    )


@query
def time_parts(t: Tables) -> DataFrame:
    """Every calendar function, on each distinct forecast start and lead."""
    valid, lead = F.col("valid_time"), F.col("lead_time")
    rows = t.forecasts().select("valid_time", "lead_time", "init_time").distinct()
    return rows.select(
        "valid_time",
        "lead_time",
        T.valid_time(F.col("init_time"), lead).alias("valid_again"),
        T.noleap_doy(valid).alias("doy_noleap"),
        T.calendar_doy(valid).alias("doy_calendar"),
        F.year(valid).alias("year"),
        F.month(valid).alias("month"),
        F.date_format(valid, "yyyyMM").alias("year_month"),
        T.season_of_month(F.month(valid)).alias("season"),
        T.season_of_doy(T.noleap_doy(valid)).alias("season_doy"),
        T.month_start(valid).cast("timestamp_ntz").alias("month_first"),
        T.month_start(valid, 1).cast("timestamp_ntz").alias("next_month"),
        T.month_start(valid, -1).cast("timestamp_ntz").alias("previous_month"),
        T.extend_end(valid, 240).alias("extended"),
        T.expected_days(F.year(valid), F.month(valid)).alias("n_days"),
        T.expected_days(F.year(valid), F.month(valid), True).alias("n_days_noleap"),
    )


@query
def asof_nearest(t: Tables) -> DataFrame:
    events = t.raw("events")
    asked = events.where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    others = events.where(F.col("event_type") != "error").select(
        "user_id", "ts", F.col("event_id").alias("matched_event_id")
    )
    return A.asof_nearest(asked, others, ["user_id"], "ts", ["matched_event_id"])


@query
def analysis_nearest_step(t: Tables) -> DataFrame:
    """Analysis value nearest to noon of every forecast's valid day, keeping the requested time."""
    noon = t.forecasts().select(
        "geo_id", (F.col("valid_time") + F.make_dt_interval(F.lit(0), F.lit(12))).alias("time")
    ).distinct()
    return rounded(A.asof_nearest(noon, t.analyses(), ["geo_id"], "time", ["t2m"]))


@query
def climatology_stream(t: Tables) -> DataFrame:
    """Climatology of single observations, folded in by a file stream over the whole table."""
    # A pattern, because a stream takes a single file only that way.
    source = f"{t.dir}/lineitem.parquet*"
    state, checkpoint = shared_dir(t.spark, "clim-state"), shared_dir(t.spark, "clim-checkpoint")
    stream = t.spark.readStream.schema(t.raw("lineitem").schema).parquet(source)
    daily = stream.select(t._area_id("l_suppkey"), F.col("l_shipdate").alias("time"), t.t2m.alias("t2m"))
    climatology_state(daily, state, checkpoint).awaitTermination()
    return rounded(climatology_from_state(t.spark, state))
