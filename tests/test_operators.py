from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arealcast.operators import align as AL
from arealcast.operators import areal as AR
from arealcast.operators import asof as A
from arealcast.operators import census as CE
from arealcast.operators import climatology as C
from arealcast.operators import graph as G
from arealcast.operators import grid as GR
from arealcast.operators import stats as ST
from arealcast.operators import verify as V
from arealcast.operators.ordering import quantiles, with_row_number


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def at(text):
    return dt.datetime.fromisoformat(text)


# ------------------------------------------------------------------ ordering
def test_quantiles_small(spark):
    df = frame(spark, [(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert quantiles(df, "v", [0.25, 0.5, 0.75]).first().q == [1.75, 2.5, 3.25]


@pytest.mark.parametrize("splits", [2, 8, 256])
def test_profile_against_numpy(spark, splits):
    rng = random.Random(splits)
    rows = [("hot", rng.choice([5.0, 1e6, rng.gauss(300, 1)])) for _ in range(3000)]
    rows += [(f"k{i % 7}", rng.expovariate(1)) for i in range(500)]
    rows += [("lone", 3.5), ("none", None), (None, 1.0), ("hot", float("nan"))]
    df = frame(spark, rows, "k string, v double")
    from arealcast.operators.ordering import profile, value_counts

    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r for r in profile(value_counts(df, "v", ["k"]), probs, ["k"], splits).collect()}
    data = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    assert set(got) == set(data.k)
    for key, part in data.groupby("k"):
        row = got[key]
        assert row.q == pytest.approx(list(np.quantile(part.v, probs)))
        assert (row["count"], row["min"], row["max"]) == (len(part), part.v.min(), part.v.max())
        assert row["mean"] == pytest.approx(part.v.mean())
        assert row["std"] == (pytest.approx(part.v.std()) if len(part) > 1 else None)


def test_row_number_text_numbers_times(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") * rng.randint(1, 9) + str(i), rng.choice("xy"), at("2024-01-01") + dt.timedelta(hours=i % 50), i) for i in range(300)]
    rows.append((None, "x", None, 300))
    df = frame(spark, rows, "s string, k string, t timestamp_ntz, i int")
    table = pd.DataFrame(rows, columns=list("skti"))
    for first in ("s", "t"):
        got = {r.i: r.rn for r in with_row_number(df, [first, "i"]).collect()}
        order = table.sort_values([first, "i"], na_position="first").i.tolist()
        assert [got[i] for i in order] == list(range(1, 302))
        got = {r.i: r.rn for r in with_row_number(df, [first, "i"], ["k"]).collect()}
        for _, part in table.groupby("k"):
            order = part.sort_values([first, "i"], na_position="first").i.tolist()
            assert [got[i] for i in order] == list(range(1, len(order) + 1))


# ------------------------------------------------------------------ as-of
def test_asof_ties_and_edges(spark):
    obs = frame(spark, [("a", at("2024-01-01 00:00"), 1.0), ("a", at("2024-01-01 06:00"), 2.0)], "k string, t timestamp_ntz, v double")
    asked = frame(
        spark,
        [("a", at(x)) for x in ("2024-01-01 03:00", "2023-12-30 00:00", "2024-02-01 00:00", "2024-01-01 02:59")] + [("b", at("2024-01-01 00:00"))],
        "k string, t timestamp_ntz",
    )
    got = {r.t: r.v for r in A.asof_nearest(asked, obs, ["k"], "t", ["v"]).collect()}
    assert got == {at("2024-01-01 03:00"): 2.0, at("2023-12-30"): 1.0, at("2024-02-01"): 2.0, at("2024-01-01 02:59"): 1.0}


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    when = lambda: at("2024-01-01") + dt.timedelta(minutes=rng.randrange(0, 20000, 10))
    obs = [(rng.choice("ab"), when(), i) for i in range(200)]
    asks = [(rng.choice("ab"), when(), i) for i in range(300)]
    got = {
        r.i: r.j
        for r in A.asof_nearest(
            frame(spark, asks, "k string, t timestamp_ntz, i int"), frame(spark, obs, "k string, t timestamp_ntz, j int"), ["k"], "t", ["j"], heavy=20
        ).collect()
    }
    for k, t, i in asks:
        best = min((abs(o[1] - t), -o[1].timestamp(), -o[2]) for o in obs if o[0] == k)
        assert got[i] == -best[2]


def test_asof_deals_its_sorts_out_by_rows(spark):
    """4,000 rows of 500 keys at 200 rows a task: 20 tasks, not the session's 4, and the same neighbours."""
    day = lambda n: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))
    obs = spark.range(2000).select((F.col("id") % 500).alias("k"), day(F.floor(F.col("id") / 500) * 2).alias("t"), F.col("id").alias("j"))
    asked = obs.select("k", (F.col("t") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("t"), F.col("j").alias("i"))
    found = A.asof_nearest(asked, obs, ["k"], "t", ["j"], task_rows=200)
    assert found.rdd.getNumPartitions() == 20
    assert found.count() == 2000 and found.where("i <> j").isEmpty()


def test_asof_of_one_hot_key_within_a_day(spark):
    """A million rows of one key in one day: many ranges, none of them large, one scan of each input, right neighbours."""
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    second = lambda c: base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)"))
    obs = spark.range(800_000).select(F.lit("hot").alias("k"), second(F.col("id") / 10).alias("t"), F.col("id").alias("j"))
    asked = spark.range(200_000).select(F.lit("hot").alias("k"), second(F.pmod(F.col("id") * 7919, 86_400_00) / 100).alias("t"), F.col("id").alias("i"))
    cuts = A.time_ranges(obs, ["k"], A.epoch_seconds(F.col("t")).cast("double")).first()._cuts
    assert len(cuts) > 200
    at_ = obs.select(A.epoch_seconds(F.col("t")).cast("double").alias("at"))
    sizes = at_.groupBy(A.range_number(F.lit(cuts), F.col("at")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("b").collect()
    assert [r.b for r in sizes] == list(range(len(cuts) + 1)) or len(sizes) >= len(cuts)
    assert max(r.n for r in sizes) < 10_000 and all(x.hi < y.lo for x, y in zip(sizes, sizes[1:]))
    found = A.asof_nearest(asked, obs, ["k"], "t", ["j"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 0  # the inputs are not read again
    tenth = F.pmod(F.col("i") * 7919, 86_400_00) / 100 * 10
    wrong = found.where(F.abs(F.col("j") - F.least(tenth, F.lit(799_999.0))) > 0.5 + 1e-6)
    assert found.count() == 200_000 and wrong.isEmpty()


# ------------------------------------------------------------------ verification
def test_bias_anomaly_comparison(spark):
    fc = frame(spark, [("01001", at("2024-02-29"), at("2024-02-28"), 24, 280.0)], "geo_id string, valid_time timestamp_ntz, init_time timestamp_ntz, lead_time int, t2m double")
    an = frame(spark, [("01001", at("2024-02-29"), 278.0), ("01001", at("2023-03-01"), 270.0)], "geo_id string, time timestamp_ntz, t2m double")
    area = frame(spark, [("01001", 5.0)], "geo_id string, aland double")
    bias = V.bias_table(fc, an, area)
    assert bias.columns == V.named(V.BIAS_COLUMNS, "t2m")
    row = bias.first()
    assert (row.bias, row.abs_error, row.aland) == (2.0, 2.0, 5.0)
    clim = C.climatology(C.drop_leap_days(an))
    anom = V.anomaly_table(bias, clim).first()
    assert (anom.day_of_year, anom.fc_anom, anom.an_anom) == (60, 10.0, 8.0)
    both = V.model_comparison(bias, bias.withColumn("bias", F.lit(-1.0)).withColumn("abs_error", F.lit(1.0)), area).first()
    assert (both.bias_diff, both.abs_error_diff) == (-3.0, -1.0)
    direct = V.compare_forecasts(fc, fc.withColumn("t2m", F.col("t2m") - 3), an, area)
    assert direct.columns == V.model_comparison(bias, bias, area).columns
    row = direct.first()
    assert (row.bias_ifs, row.bias_aifs, row.bias_diff, row.abs_error_diff, row.aland) == (2.0, -1.0, -3.0, -1.0, 5.0)


def test_end_date_keeps_midnight_only(spark):
    df = frame(spark, [(at("2024-01-10 00:00"), 6, "a"), (at("2024-01-10 06:00"), 6, "a")], "valid_time timestamp_ntz, lead_time int, geo_id string")
    assert V.filter_bias(df, end="2024-01-10").count() == 1
    assert V.filter_bias(df).count() == 2


def test_acc(spark):
    rows = [(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, -1.0), (2, 2.0, -2.0), (3, 4.0, 1.0), (3, 4.0, 2.0)]
    df = frame(spark, rows, "g int, x double, y double").withColumn("w", F.lit(2.0))
    got = {r.g: r.acc for r in V.anomaly_correlation(df, "x", "y", "w", ["g"]).collect()}
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(-1) and got[3] is None


def test_spill_over_prunes_init_months(spark, tmp_path):
    rows = [("a", at("2025-01-10 12:00"), at("2024-12-31 12:00"), 240, 1.0), ("a", at("2025-02-01"), at("2025-01-31"), 24, 1.0), ("a", at("2024-12-01"), at("2024-11-30"), 24, 1.0)]
    df = frame(spark, rows, "geo_id string, valid_time timestamp_ntz, init_time timestamp_ntz, lead_time int, t2m double")
    AL.chunk_key(df, "init_time").write.partitionBy("year", "month").parquet(str(tmp_path / "fc"))
    out = V.spill_over_month(spark.read.parquet(str(tmp_path / "fc")), 2025, 1, 240)
    assert [r.valid_time for r in out.collect()] == [at("2025-01-10 12:00")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [year" in plan


def test_climatology_merge_equals_whole(spark):
    rows = [("a", at(f"{y}-03-01"), float(y)) for y in (2020, 2021, 2022)] + [("a", at("2020-02-29"), 1e9)]
    df = C.drop_leap_days(frame(spark, rows, "geo_id string, time timestamp_ntz, t2m double"))
    parts = C.partial_climatology(df.where(F.year("time") == 2020)).unionByName(C.partial_climatology(df.where(F.year("time") > 2020)))
    assert C.merge_climatology(parts).first().t2m_clim == C.climatology(df).first().t2m_clim == 2021.0


# ------------------------------------------------------------------ areal
def weights(spark, rows):
    return frame(spark, [(0, g, float(i), 0.0, float(w)) for g, i, w in rows], "grid_id int, geo_id string, lat double, lon double, w double")


def cells(spark, values, kind):
    return frame(spark, [(0, float(i), 0.0, v) for i, v in enumerate(values)], f"grid_id int, lat double, lon double, {kind}")


def test_weighted_mean_ignores_missing(spark):
    w = weights(spark, [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("b", 1, 1)])
    rows = AR.area_weighted_mean(cells(spark, [10.0, None, 20.0], "value double"), w).collect()
    assert [(r.geo_id, r.value) for r in rows] == [("a", pytest.approx(50 / 3))]
    with pytest.raises(KeyError):
        AR.area_weighted_mean(cells(spark, [1.0], "value double"), w, "t2m")


@pytest.mark.parametrize(
    "codes, want",
    [
        ([0, 1, 0, 1], (1, 50.0, 0, 50.0)),
        ([2, 2, 2, 2], (2, 100.0, None, 0.0)),
        ([None, None, None, None], (None, 0.0, None, 0.0)),
        ([1, 1, 1, None], (1, 75.0, None, 0.0)),
    ],
)
def test_top_two(spark, codes, want):
    w = weights(spark, [("a", i, 1) for i in range(4)])
    row = AR.top_two(AR.category_fractions(cells(spark, codes, "category int"), w)).first()
    assert tuple(row)[1:] == want


# ------------------------------------------------------------------ grid
def test_axis_bounds(spark):
    df = frame(spark, [(0, x) for x in (0.0, 1.0, 3.0)] + [(1, 7.0)], "grid_id int, lat double")
    got = [(r.lat_lo, r.lat_hi) for r in GR.axis_bounds(df, "lat").orderBy("grid_id", "lat").collect()]
    assert got == [(-0.5, 0.5), (0.5, 2.0), (2.0, 4.0), (6.5, 7.5)]


def test_regrid(spark):
    src = frame(spark, [(0, float(y), float(x), 10.0 * y + x) for y in range(3) for x in range(3)], "grid_id int, lat double, lon double, value double")
    targets = frame(spark, [(0, 0.5, 1.25), (0, 2.0, 2.0), (0, 5.0, 0.0)], "grid_id int, lat double, lon double")
    near = {(r.lat, r.lon): r.value for r in GR.regrid_nearest(src, targets, 0.0, 0.0, 1.0).collect()}
    assert near == {(0.5, 1.25): 1.0, (2.0, 2.0): 22.0, (5.0, 0.0): None}
    lin = {(r.lat, r.lon): r.value for r in GR.regrid_bilinear(src, targets, 0.0, 0.0, 1.0).collect()}
    assert lin == {(0.5, 1.25): pytest.approx(6.25), (2.0, 2.0): pytest.approx(22.0), (5.0, 0.0): None}


def test_regrid_looks_each_target_up_once(spark):
    """A target asked for twice has its value twice, and rows of many small grids are dealt out to all tasks."""
    src = frame(spark, [(0, float(y), float(x), 10.0 * y + x) for y in range(3) for x in range(3)], "grid_id int, lat double, lon double, value double")
    targets = frame(spark, [(0, 0.5, 1.25), (0, 0.5, 1.25), (0, 2.0, 0.5)], "grid_id int, lat double, lon double")
    found = GR.regrid_bilinear(src, targets, 0.0, 0.0, 1.0)
    assert sorted(r.value for r in found.collect()) == pytest.approx([6.25, 6.25, 20.5])
    boxes = spark.range(300).select(F.col("id").cast("int").alias("grid_id"), *[F.lit(v).alias(n) for n, v in (("south", 0.0), ("north", 2.0), ("west", 0.0), ("east", 3.0))])
    dealt = GR.regular_grid(boxes, 1.0).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(r["count"] for r in dealt)[0] > 300 * 12 / 4 / 2 and len(dealt) == 4


def test_rmse_identity_and_detrend(spark):
    rng = random.Random(2)
    rows = [(0, 0.0, 0.0, at("2024-01-01") + dt.timedelta(days=i), rng.random(), rng.random(), rng.random()) for i in range(30)]
    df = frame(spark, rows, "grid_id int, lat double, lon double, time timestamp_ntz, f double, a double, c double")
    r = GR.cell_rmse_components(df).first()
    assert r.rmse**2 == pytest.approx(r.fc_variance + r.an_variance - 2 * r.covariance)
    got = [x.detrended for x in GR.detrend(GR.with_time_index(df), "f").orderBy("time").collect()]
    y = np.array([x[4] for x in rows])
    line = np.polyfit(np.arange(30), y, 1)
    assert got == pytest.approx(list(y - np.polyval(line, np.arange(30))))


# ------------------------------------------------------------------ statistics
def test_quartile_labels(spark):
    df = frame(spark, [(float(i),) for i in range(1, 9)], "v double")
    got = [r.quartile for r in ST.quartile_labels(df, "v").orderBy("v").collect()]
    assert got == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]
    with pytest.raises(Exception, match="unique"):
        ST.quartile_labels(frame(spark, [(1.0,)] * 8, "v double"), "v").collect()


def test_describe_single_row(spark):
    row = ST.describe(frame(spark, [("a", 2.0)], "k string, v double"), "v", ["k"]).first()
    assert row["std"] is None and row["q50"] == 2.0 and row["count"] == 1


def test_band_edges_count_twice(spark):
    df = frame(spark, [(0.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "x double, pop double")
    out = ST.share_by_band(df, "x", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), ["pop"]).orderBy("band").collect()
    assert [r.share_pop for r in out] == [0.5, 0.75]


def test_histogram_of_constant(spark):
    out = ST.shared_histogram(frame(spark, [(5.0,)] * 3, "v double"), "v").collect()
    assert len(out) == 30 and sum(r.n for r in out) == 3
    assert min(r.bin_lo for r in out) == pytest.approx(4.9)


def test_kde_integrates_to_one(spark):
    rng = random.Random(3)
    df = frame(spark, [("a", rng.gauss(0, 2)) for _ in range(200)], "k string, v double")
    out = ST.gaussian_kde(df, "v", ["k"]).orderBy("grid_index").collect()
    assert np.trapezoid([r.density for r in out], [r.x for r in out]) == pytest.approx(1, abs=5e-3)


def test_split_is_stable_and_near_its_shares(spark):
    out = ST.train_valid_test(spark.range(20000), "id").groupBy("split").count().collect()
    share = {r.split: r["count"] / 20000 for r in out}
    assert share["test"] == pytest.approx(0.10, abs=0.01)
    assert share["valid"] == pytest.approx(0.09, abs=0.01)
    assert share["train"] == pytest.approx(0.81, abs=0.01)


# ------------------------------------------------------------------ census and graph
def test_census_columns(spark):
    df = frame(spark, [("01001", "A", 1.0, 2.0, None, None)], "geo_id string, NAME string, X_001E double, X_001M double, X_001EA string, X_001MA string")
    assert CE.drop_annotations(df).columns == ["geo_id", "NAME", "X_001E", "X_001M"]
    est, moe = CE.split_estimates_and_margins(df.drop("X_001EA", "X_001MA"), ["geo_id", "NAME"])
    assert est.columns == moe.columns == ["geo_id", "NAME", "X_001"]
    assert CE.estimates_only(df).columns == ["geo_id", "NAME", "X_001E"]


def test_json_rows(spark):
    text = '[["NAME","B1","state"],["A","12","01"],["B","x","02"]]'
    out = CE.rows_from_json(frame(spark, [(text,)], "p string"), "p", ["NAME", "state", "B1", "gone"], {"B1": "pop"})
    assert sorted(tuple(r) for r in out.collect()) == [("A", "01", 12.0, None), ("B", "02", None, None)]


def test_contiguity_of_a_5_by_5_layer(spark):
    from arealcast.operators.spatial import rectangle_ring

    grid = spark.range(25).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("geo_id"), (F.col("id") % 5).alias("i"), F.floor(F.col("id") / 5).alias("j"))
    polys = grid.select("geo_id", rectangle_ring(F.col("i"), F.col("i") + 1, F.col("j"), F.col("j") + 1).alias("rings"))
    nbrs = G.queen_neighbours(polys)
    nodes = G.node_table(polys)
    assert G.upper_triangle(G.edge_table(nbrs, nodes)).count() == 72
    assert sorted({r["count"] for r in nbrs.groupBy("geo_id").count().collect()}) == [3, 5, 8]
    stats = G.neighbour_stats(nodes, nbrs).first()
    assert (stats.n_islands, stats.n_nonzero) == (0, 144)
    back = nbrs.select(F.col("neighbour").alias("geo_id"), F.col("geo_id").alias("neighbour"))
    assert back.exceptAll(nbrs).isEmpty()
    assert G.edge_energy(nbrs, nodes.withColumn("v", F.lit(2.0)), "v").first().energy == 0.0


# ------------------------------------------------------------------ alignment
def test_align_keeps_both_sides(spark):
    fc = frame(spark, [("f1", at("2024-01-01"), 24), ("f2", at("2024-01-01"), 48)], "path string, init_time timestamp_ntz, lead_time int")
    an = frame(spark, [("a1", at("2024-01-02")), ("a2", at("2024-01-02")), ("a3", at("2024-01-09"))], "path string, time timestamp_ntz")
    left, right = AL.align(fc, an)
    assert [r.path for r in left.collect()] == ["f1"]
    assert [r.path for r in right.collect()] == ["a2"]


def test_forecast_paths_with_and_without_month_folders(spark):
    rows = [("file:/d/1200/6/2024/01/m1_fc_05_20240105.nc",), ("/d/0000/24/m1_20240106.nc",), ("/d/0000/24/readme.txt",), ("/d/0000/24/m1_20249906.nc",)]
    got = sorted((r.init_time, r.init_hour, r.lead_time) for r in AL.forecast_paths(frame(spark, rows, "path string")).collect())
    assert got == [(at("2024-01-05 12:00"), "1200", 6), (at("2024-01-06"), "0000", 24)]


def test_grid_mismatch_names_the_file(spark):
    ref = frame(spark, [(0.0, 0.0), (1.0, 0.0)], "lat double, lon double")
    files = frame(spark, [("ok", 0.0, 0.0), ("ok", 1.0, 0.0), ("bad", 0.1, 0.0), ("bad", 1.0, 0.0)], "path string, lat double, lon double")
    assert [tuple(r) for r in AL.grid_mismatches(files, ref).collect()] == [("bad", 1, 1)]


def test_grid_mismatch_tells_grids_apart(spark):
    schema = "path string, grid_id int, lat double, lon double"
    ref = frame(spark, [(None, 0, 0.0, 0.0), (None, 0, 1.0, 0.0)], schema)
    files = frame(spark, [("mixed", 0, 0.0, 0.0), ("mixed", 1, 1.0, 0.0)], schema)
    assert [tuple(r) for r in AL.grid_mismatches(files, ref).collect()] == [("mixed", 1, 1)]


def test_asof_of_one_busy_key(spark):
    """200,000 rows of one key inside one bucket: both neighbours are running values, so this takes seconds."""
    base = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id"))
    second = lambda c: base + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    seen = rows.where("id % 4 != 0").select("k", second(F.col("id") / 4).alias("t"), F.col("id").alias("v"))
    asked = rows.where("id % 4 = 0").select("k", second(F.col("id") / 4).alias("t"), F.col("id").alias("want"))
    found = A.asof_nearest(asked, seen, ["k"], "t", ["v"])
    # The neighbours before and behind are equally near, so the later one counts.
    assert found.where(F.col("v") == F.col("want") + 1).count() == found.count() == 50_000


def test_acc_of_small_units(spark):
    rows = [(1, x, x, 1.0) for x in (1e-10, 2e-10, 3e-10)] + [(2, 5.0, x, 1.0) for x in (1.0, 2.0, 4.0)]
    df = frame(spark, rows, "valid_time int, x double, y double, w double")
    got = {r.valid_time: r.acc for r in V.anomaly_correlation(df, "x", "y", "w").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] is None


def test_init_time_violations(spark):
    rows = [("f", at("2024-01-02"), 24, at("2024-01-01")), ("g", at("2024-01-02"), 24, at("2024-01-01")), ("g", at("2024-01-02 06:00"), 24, at("2024-01-01"))]
    df = frame(spark, rows, "path string, valid_time timestamp_ntz, lead_time int, declared_init timestamp_ntz")
    assert [r.path for r in AL.init_time_violations(df).collect()] == ["g"]


def test_row_numbers_of_ids_with_one_prefix(spark):
    from arealcast.operators import ordering as O

    ids = spark.range(3000).select(F.format_string("0500000US%05d", F.col("id") * 7).alias("geo_id"))
    got = O.with_row_number(ids, ["geo_id"]).orderBy("geo_id").collect()
    assert [r.rn for r in got] == list(range(1, 3001))
    none = spark.createDataFrame([(None,), ("",), ("a",), ("ab",), ("é",)], "geo_id string")
    got = O.with_row_number(none, ["geo_id"]).collect()
    assert {r.geo_id: r.rn for r in got} == {None: 1, "": 2, "a": 3, "ab": 4, "é": 5}


def test_row_numbers_with_few_first_values_use_all_tasks(spark):
    from arealcast.operators import ordering as O

    rows = spark.range(100_000).select((F.col("id") % 2).alias("k"), F.lit(None).cast("string").alias("s"), F.xxhash64("id").alias("h"), "id")
    ranges = O.dealt_by_range(rows, ["k", "s", "h"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 40_000
    got = O.with_row_number(rows, ["k", "s", "h"])
    ordered = got.orderBy("rn").select("k", "h", "rn").toPandas()
    assert ordered.rn.tolist() == list(range(1, 100_001))
    assert ordered[["k", "h"]].equals(ordered[["k", "h"]].sort_values(["k", "h"], ignore_index=True))
    within = O.with_row_number(rows, ["s", "h"], ["k"]).groupBy("k").agg(F.min("rn").alias("a"), F.max("rn").alias("b"), F.count_distinct("rn").alias("n"))
    assert {(r.a, r.b, r.n) for r in within.collect()} == {(1, 50_000, 50_000)}


def test_moments_merge_without_cancelling(spark, monkeypatch):
    """Spreads of 1e-10 around zero and of 1e-3 around 3e5, in many parts, with zero weights and rows left out."""
    from arealcast.operators import moments as M

    monkeypatch.setattr(M, "HELD", 500)
    rng = np.random.default_rng(3)
    n = 6000
    table = pd.DataFrame({"g": rng.integers(0, 5, n), "x": rng.normal(size=n), "w": rng.uniform(0, 3, n) * (rng.random(n) > 0.1)})
    table["y"] = 0.6 * table.x + rng.normal(size=n)
    for scale, shift in ((1e-10, 0.0), (1e-3, 3e5)):
        data = table.assign(x=shift + scale * table.x, y=-shift + scale * table.y)
        df = spark.createDataFrame(data).repartition(6)
        df = df.unionByName(spark.createDataFrame([(1, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "g long, x double, w double, y double"))
        got = {r.g: (r.acc, r.n_areas) for r in V.anomaly_correlation(df, "x", "y", "w", ["g"]).collect()}
        for g, part in data.groupby("g"):
            dx, dy = part.x - np.average(part.x, weights=part.w), part.y - np.average(part.y, weights=part.w)
            want = (part.w * dx * dy).sum() / math.sqrt((part.w * dx * dx).sum() * (part.w * dy * dy).sum())
            assert got[g][0] == pytest.approx(want, rel=1e-6) and got[g][1] == len(part)
        assert len(got) == 5
    every = M.weighted_moments(df, "x", "y", "w", []).first().m
    assert every.n == n + 1 and every.w == pytest.approx(table.w.sum() + 1)


def test_kde_reaches_no_further_than_its_kernel(spark):
    """A far outlier widens the grid; every value still meets only the points that it can reach."""
    from arealcast.operators import stats as ST

    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(size=20_000) * 1e-3, [1e4]])
    df = spark.createDataFrame([("a", float(v)) for v in data] + [("a", None), ("b", 1.0)], "g string, v double")
    got = ST.gaussian_kde(df, "v", ["g"], gridsize=3000)
    rows = sorted(tuple(r) for r in got.collect())
    h = data.std(ddof=1) * len(data) ** -0.2
    grid = np.linspace(data.min() - 3 * h, data.max() + 3 * h, 3000)
    want = np.zeros(3000)
    for v in data:
        want += np.exp(-(((grid - v) / h) ** 2) / 2)
    want /= len(data) * h * math.sqrt(2 * math.pi)
    assert [r[1] for r in rows] == list(range(3000)) and [r[2] for r in rows] == pytest.approx(grid.tolist())
    assert [r[3] for r in rows] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-300)
    assert rows[1500][3] == 0.0


def test_fit_leaves_out_dependent_terms(spark):
    from arealcast.operators import model_prep as M

    rows = spark.range(50).select(
        F.sin("id").alias("season_sin"), F.cos("id").alias("season_cos"), (F.sin("id") * 2).alias("z_a"),
        (3 + 2 * F.sin("id") - F.cos("id")).alias("mean_bias"),
    )
    got = {r.term: r.coefficient for r in M.fixed_effects(rows).collect()}
    assert got["z_a"] is None
    assert [got[n] for n in ("intercept", "season_sin", "season_cos")] == pytest.approx([3, 2, -1])
    assert {r.coefficient for r in M.fixed_effects(rows.limit(0)).collect()} == {None}
