from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from arealcast.functions import ids as I
from arealcast.functions import scalars as S
from arealcast.functions import timefn as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "day, want",
    [("2024-02-29", 60), ("2024-03-01", 60), ("2023-03-01", 60), ("2024-12-31", 365), ("1900-03-01", 60), ("2000-12-31", 365)],
)
def test_noleap_day(spark, day, want):
    assert one(spark, T.noleap_doy(ts(day))) == want


def test_calendar_day(spark):
    assert one(spark, T.calendar_doy(ts("2024-12-31"))) == 366


def test_valid_and_init_time(spark):
    assert one(spark, T.valid_time(ts("2024-12-31 12:00:00"), F.lit(240))) == dt.datetime(2025, 1, 10, 12)
    assert one(spark, T.init_time(ts("2025-01-10 12:00:00"), F.lit(240))) == dt.datetime(2024, 12, 31, 12)


def test_seasons(spark):
    by_month = [one(spark, T.season_of_month(F.lit(m))) for m in (12, 2, 3, 8, 11)]
    assert by_month == ["DJF", "DJF", "MAM", "JJA", "SON"]
    by_day = [one(spark, T.season_of_doy(F.lit(d))) for d in (1, 59, 60, 151, 152, 243, 244, 334, 335, 365)]
    assert by_day == ["DJF", "DJF", "MAM", "MAM", "JJA", "JJA", "SON", "SON", "DJF", "DJF"]
    assert one(spark, T.season_of_doy(F.lit(366))) is None


def test_expected_days(spark):
    assert one(spark, T.expected_days(F.lit(2024), F.lit(2))) == 29
    assert one(spark, T.expected_days(F.lit(2024), F.lit(2), True)) == 28
    assert one(spark, T.expected_days(F.lit(2023), F.lit(2), True)) == 28


def test_year_months_clips_both_ends(spark):
    rows = T.year_months(spark, "2023-12-15", "2024-02-10").orderBy("year", "month").collect()
    assert [(r.year, r.month, r.n_days) for r in rows] == [(2023, 12, 17), (2024, 1, 31), (2024, 2, 10)]


def test_time_axis_and_leads(spark):
    axis = T.time_axis(spark, "2024-01-01 00:00:00", "2024-01-02 12:00:00", 12)
    assert axis.count() == 4
    assert T.with_leads(axis, [0, 24, 240]).count() == 12


def test_epoch_seconds_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, T.epoch_seconds(ts("2024-03-10 02:30:15"))) == 1710037815
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ids(spark):
    assert one(spark, I.zfill(F.lit("1001"), 5)) == "01001"
    assert one(spark, I.zfill(F.lit("123456"), 5)) == "123456"
    assert one(spark, I.county_id(F.lit(1), F.lit(3))) == "01003"
    assert one(spark, I.tract_id(F.lit(1), F.lit(3), F.lit(20100))) == "01003020100"
    assert one(spark, I.id_tail(F.lit("0500000US24001"), 5)) == "24001"


def test_file_dates(spark):
    assert one(spark, I.file_date(F.lit("/x/m1_fc_2t_0000_24_20240105.nc"))) == dt.date(2024, 1, 5)
    assert one(spark, I.file_date(F.lit("/x/m1_fc_2t_0000_24_20240105.grib"))) is None
    assert one(spark, I.file_date(F.lit("/x/m1_20240105.grib"), "(?:nc|grib)")) == dt.date(2024, 1, 5)
    assert one(spark, I.file_date(F.lit("/x/m1_20241305.nc"))) is None


def test_chunk_names(spark):
    row = spark.range(1).select(*I.chunk_parts(F.lit("ifs_fc_2t_county_2024_03_lead012.parquet"))).first()
    assert tuple(row) == ("ifs_fc", 2024, 3, 12)
    row = spark.range(1).select(*I.chunk_parts(F.lit("ifs_an_2t_county_2024_03.parquet"))).first()
    assert tuple(row) == ("ifs_an", 2024, 3, None)


def test_column_fallback(spark):
    df = spark.createDataFrame([("a", 1.0)], "GEOID string, Shape_Area double")
    assert I.first_present(df, ["ALAND", "Shape_Area", "area"]) == "Shape_Area"
    assert I.keep_present(df, ["x", "Shape_Area"]).columns == ["Shape_Area"]
    with pytest.raises(ValueError):
        I.first_present(df, ["x"])


def test_scalars(spark):
    assert one(spark, S.safe_ln(F.lit(0.0))) is None
    assert one(spark, S.percent(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.percent(F.lit(1.0), F.lit(4.0))) == 25.0
    assert one(spark, S.negative_to_null(F.lit(-666666666.0))) is None
    assert one(spark, S.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, S.wrap_longitude(F.lit(235.0))) == -125.0
    assert one(spark, S.wrap_longitude(F.lit(180.0))) == -180.0
    assert one(spark, S.cyclic_sin01(F.lit(91.25), 365.0)) == pytest.approx(1.0)
    assert one(spark, S.geopotential_height(F.lit(9.80665))) == 1.0
    assert one(spark, S.cos_latitude(F.lit(60.0))) == pytest.approx(math.cos(math.pi / 3))
