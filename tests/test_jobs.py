"""The batch jobs from cells to model input on the smallest data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arealcast.operators import grid as GR
from arealcast.operators import spatial as SP
from arealcast.plans import jobs as J
from arealcast.plans.registry import Tables
from arealcast.sources import tables as TB


def test_cells_to_model_input(spark, folder, tmp_path):
    p = lambda name: str(tmp_path / name)
    t = Tables(spark, folder)
    SP.overlap_weights(GR.grid_cells(t.cells()), t.polygons(), ["grid_id"]).write.parquet(p("w"))
    w = spark.read.parquet(p("w"))
    obs = t.cell_observations()
    fc = obs.select("grid_id", "lat", "lon", F.col("time").alias("valid_time"), "lead_time", F.col("f").alias("t2m"))
    second = fc.withColumn("t2m", F.col("t2m") + 1.5)
    an = obs.select("grid_id", "lat", "lon", "time", F.col("a").alias("t2m"))

    assert J.aggregate_forecasts(fc, w, p("fc"))
    assert not J.aggregate_forecasts(fc, w, p("fc"))
    assert J.aggregate_forecasts(second, w, p("fc2"))
    assert J.aggregate_analyses(an, w, p("an"))
    assert J.aggregate_reanalysis(an, w, p("daily"))
    area = t.land_area()
    assert J.derive_bias(spark, p("fc"), p("an"), area, p("bias"))
    assert J.derive_bias(spark, p("fc2"), p("an"), area, p("bias2"))
    assert not J.derive_anomalies(spark, p("bias"), p("clim"), p("anom"))
    assert J.build_climatology(spark, p("daily"), p("clim"))
    assert J.derive_anomalies(spark, p("bias"), p("clim"), p("anom"))
    assert J.derive_comparison(spark, p("bias"), p("bias2"), area, p("cmp"))
    assert not J.derive_comparison(spark, p("bias"), p("bias2"), area, p("cmp"))
    diff = TB.read_table(spark, p("cmp")).agg(F.min("bias_diff"), F.max("bias_diff"), F.count("*")).first()
    assert diff[0] == pytest.approx(1.5) and diff[1] == pytest.approx(1.5)
    assert diff[2] == TB.read_table(spark, p("bias")).count() > 6000

    # Over its own base period the daily series departs from its normals by zero on average.
    daily, clim = spark.read.parquet(p("daily")), TB.read_table(spark, p("clim"))
    from arealcast.functions import timefn as T

    gap = daily.withColumn("day_of_year", T.noleap_doy(F.col("time"))).join(clim, ["geo_id", "day_of_year"])
    means = gap.groupBy("geo_id").agg(F.avg(F.col("t2m") - F.col("t2m_clim")).alias("m")).collect()
    assert [r.m for r in means] == pytest.approx([0.0] * len(means), abs=1e-9)

    assert J.summarise_categories(t.cells(), w, p("cat"))
    J.store_graph(t.polygons(), p("edges"), p("nodes"), ["grid_id"])
    assert TB.read_table(spark, p("nodes")).count() == 10
    J.store_model_input(TB.read_table(spark, p("bias")), TB.read_table(spark, p("cat")), t.census(), ["B01001_001E"], p("model"))
    model = TB.read_table(spark, p("model"))
    assert "demo_B01001_001E" in model.columns and model.where("koppen_class IS NOT NULL").count() > 0


def test_gridded_scan_errors(spark):
    df = spark.createDataFrame([(1.0, 190.0, 2.0, 500)], "latitude double, lon double, z double, level int")
    with pytest.raises(ValueError, match="level"):
        GR.gridded_scan(df, "z")
    with pytest.raises(KeyError):
        GR.gridded_scan(df, "t2m")
    assert tuple(GR.gridded_scan(df, "z", ["level"]).first()) == (0, 1.0, -170.0, 500, 2.0)
