"""Registered queries: statistics, census attributes and model input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.functions import ids as I
from arealcast.functions import scalars as S
from arealcast.functions import timefn as T
from arealcast.operators import areal as AR
from arealcast.operators import census as CE
from arealcast.operators import graph as G
from arealcast.operators import grid as GR
from arealcast.operators import model_prep as M
from arealcast.operators import spatial as SP
from arealcast.operators import stats as ST
from arealcast.operators import verify as V
from arealcast.plans.registry import Tables, query, rounded
from arealcast.session import materialize

# Probabilities of the quantile vector.
TWENTIETHS = [round(0.05 * k, 2) for k in range(21)]


def _with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", T.season_of_month(F.month("valid_time")))


def _income(t: Tables) -> DataFrame:
    return t.census().select(
        "geo_id",
        F.col("B01001_001E").alias("population"),
        F.col("B17001_002E").alias("poor"),
        S.negative_to_null(F.col("B19013_001E")).alias("income"),
    )


@query
def describe_overall(t: Tables) -> DataFrame:
    return rounded(ST.describe(t.bias(), "abs_error"))


@query
def describe_by_year(t: Tables) -> DataFrame:
    return rounded(ST.describe(t.bias().withColumn("year", F.year("valid_time")), "abs_error", ["year"]))


@query
def describe_by_month(t: Tables) -> DataFrame:
    return rounded(ST.describe(t.bias().withColumn("month", F.month("valid_time")), "abs_error", ["month"]))


@query
def describe_by_season(t: Tables) -> DataFrame:
    return rounded(ST.describe(_with_season(t.bias()), "abs_error", ["season"]))


@query
def describe_by_area(t: Tables) -> DataFrame:
    return rounded(ST.describe(t.bias(), "abs_error", ["geo_id"]))


@query
def describe_by_valid_time(t: Tables) -> DataFrame:
    return rounded(ST.describe(t.bias(), "bias", ["valid_time"]))


@query
def polygon_mean_std(t: Tables) -> DataFrame:
    return rounded(ST.mean_std(t.bias(), "abs_error", ["geo_id"]))


@query
def season_pivot(t: Tables) -> DataFrame:
    return rounded(ST.season_columns(_with_season(t.bias()), "abs_error", ["geo_id"]))


@query
def histogram_bias(t: Tables) -> DataFrame:
    return rounded(ST.shared_histogram(t.bias(), "bias"))


@query
def histogram_density_by_lead(t: Tables) -> DataFrame:
    return rounded(ST.shared_histogram(t.bias(), "bias", ["lead_time"], density=True))


@query
def box_stats(t: Tables) -> DataFrame:
    return rounded(ST.box_stats(_with_season(t.bias()), "abs_error", ["season"], whis=5.0))


@query
def box_stats_by_year(t: Tables) -> DataFrame:
    return rounded(ST.box_stats(t.bias().withColumn("year", F.year("valid_time")), "bias", ["year"]))


@query
def kde_rows(t: Tables) -> DataFrame:
    return rounded(ST.gaussian_kde(_with_season(t.bias()), "bias", ["season"]))


@query
def kde_common_norm(t: Tables) -> DataFrame:
    return rounded(ST.gaussian_kde(_with_season(t.bias()), "bias", ["season"], gridsize=50, common_norm=True))


@query
def quantile_vector(t: Tables) -> DataFrame:
    return rounded(ST.quantile_vector(_income(t), "income", TWENTIETHS))


@query
def population_bands(t: Tables) -> DataFrame:
    rows = _income(t)
    edges = ST.fixed_width_edges(rows, "income", 500.0)
    return rounded(ST.share_by_band(rows, "income", edges, ["population", "poor"]))


@query
def population_bands_quantile(t: Tables) -> DataFrame:
    rows = _income(t)
    edges = ST.quantile_edges(rows, "income", TWENTIETHS)
    return rounded(ST.share_by_band(rows, "income", edges, ["population", "poor"], open_tail=True))


@query
def quartile_labels(t: Tables) -> DataFrame:
    return rounded(ST.quartile_labels(_income(t), "income").select("geo_id", "income", "quartile"))


@query
def rank_by_bias(t: Tables) -> DataFrame:
    return ST.rank_areas(rounded(V.area_mean_bias(t.bias(), 24)))


@query
def zscore(t: Tables) -> DataFrame:
    return rounded(ST.zscore(_income(t).select("geo_id", "population", "poor"), ["population", "poor"]))


@query
def min_max(t: Tables) -> DataFrame:
    return rounded(ST.rescale(t.cells().select("grid_id", "lat", "lon", "value"), ["lat", "value"]))


@query
def mean_range(t: Tables) -> DataFrame:
    return rounded(ST.rescale(t.cells().select("grid_id", "lat", "lon", "value"), ["lon", "value"], centre="mean"))


@query
def cyclic_features(t: Tables) -> DataFrame:
    doy, hour = T.noleap_doy(F.col("time")), F.hour("time")
    return rounded(
        t.cell_observations().select("time", "lon").distinct().select(
            "time",
            "lon",
            S.annual_sin(doy).alias("doy_sin"),
            S.annual_cos(doy).alias("doy_cos"),
            S.cyclic_sin01(doy, 365.0).alias("doy_01"),
            S.cyclic_sin01(hour, 24.0).alias("hour_01"),
            S.cyclic_cos01(F.col("lon"), 360.0).alias("lon_01"),
        )
    )


@query
def split_counts(t: Tables) -> DataFrame:
    rows = ST.train_valid_test(t.raw("events").select("event_id", "event_type"), "event_id")
    return rows.groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def random_times(t: Tables) -> DataFrame:
    return ST.pick_random(t.bias(), "valid_time", 4, seed=7)


# ------------------------------------------------------------------ census
@query
def census_estimates(t: Tables) -> DataFrame:
    return rounded(CE.split_estimates_and_margins(CE.drop_annotations(t.census()), ["geo_id", "NAME"])[0])


@query
def census_margins(t: Tables) -> DataFrame:
    return rounded(CE.split_estimates_and_margins(CE.drop_annotations(t.census()), ["geo_id", "NAME"])[1])


@query
def wide_split_est_moe(t: Tables) -> DataFrame:
    """Estimates and margins side by side again, in long form."""
    est, moe = CE.split_estimates_and_margins(CE.drop_annotations(t.census()), ["geo_id", "NAME"])
    left = CE.to_long(est.drop("NAME"), ["geo_id"], value="estimate")
    right = CE.to_long(moe.drop("NAME"), ["geo_id"], value="margin")
    return rounded(left.join(right, ["geo_id", "variable"], "left"))


@query
def census_estimate_columns(t: Tables) -> DataFrame:
    return rounded(CE.estimates_only(t.census()))


@query
def census_rates(t: Tables) -> DataFrame:
    rows = t.census().join(t.area(), "geo_id")
    return rounded(
        rows.select(
            "geo_id",
            S.percent(F.col("B17001_002E"), F.col("B17001_001E")).alias("poverty_rate"),
            S.ratio(F.col("B17001_002E"), F.col("B17001_001E")).alias("poverty_ratio"),
            (S.population_density(F.col("B01001_001E"), F.col("aland_m2")) * 1e9).alias("density_1e9"),
            S.negative_to_null(F.col("B19013_001E")).alias("income"),
        )
    )


@query
def census_glued(t: Tables) -> DataFrame:
    census = t.census()
    parts = [
        census.select("geo_id", "B01001_001E", "NAME"),
        census.select("geo_id", "B17001_002E", "NAME"),
        census.select("geo_id", "B19013_001E", "NAME"),
    ]
    return rounded(CE.glue_tables(parts, "geo_id", ["NAME"]))


@query
def tables_outer_aligned(t: Tables) -> DataFrame:
    return rounded(
        CE.outer_align(
            [V.area_mean_bias(t.bias(), 24), _income(t), t.land_area()], "geo_id"
        )
    )


@query
def map_layer(t: Tables) -> DataFrame:
    """Polygons with their mean bias, unfilled polygons kept."""
    layer = t.area().select("geo_id", "statefp")
    return rounded(layer.join(V.area_mean_bias(t.bias(), 24), "geo_id", "left"))


@query
def fips_ids(t: Tables) -> DataFrame:
    row = t.raw("supplier").select("s_suppkey", "s_nationkey")
    state, county = F.col("s_nationkey"), F.col("s_suppkey")
    return row.select(
        "s_suppkey",
        I.county_id(state, county).alias("county_id"),
        I.tract_id(state, county, county * 7).alias("tract_id"),
        I.normalize_county_id(county).alias("geo_id"),
        I.id_tail(F.concat(F.lit("0500000US"), I.county_id(state, county)), 5).alias("tail_id"),
    )


@query
def json_rows_to_table(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    payload = F.to_json(
        F.array(
            F.array(F.lit("NAME"), F.lit("B01001_001E"), F.lit("state")),
            F.array(
                F.col("s_name"),
                F.when(F.col("s_acctbal") < 0, "N/A").otherwise((F.col("s_suppkey") * 3).cast("string")),
                text("s_nationkey"),
            ),
        )
    )
    rows = t.raw("supplier").select(payload.alias("payload"))
    return CE.rows_from_json(rows, "payload", ["NAME", "state", "B01001_001E"], {"B01001_001E": "population"})


# ------------------------------------------------------------------ graph and model input
@query
def contiguity_edges(t: Tables) -> DataFrame:
    polygons = t.polygons(wide=True)
    nodes = G.node_table(polygons)
    return G.upper_triangle(G.edge_table(G.queen_neighbours(polygons, ["grid_id"]), nodes))


@query
def node_order(t: Tables) -> DataFrame:
    return G.node_table(t.polygons())


@query
def contiguity_stats(t: Tables) -> DataFrame:
    polygons = t.polygons(wide=True)
    return rounded(G.neighbour_stats(G.node_table(polygons), G.queen_neighbours(polygons, ["grid_id"])))


@query
def edge_energy(t: Tables) -> DataFrame:
    values = V.area_mean_bias(t.bias(), 24)
    return rounded(G.edge_energy(G.queen_neighbours(t.polygons(wide=True), ["grid_id"]), values, "mean_bias"))


def _categories(t: Tables) -> DataFrame:
    weights = SP.overlap_weights(GR.grid_cells(t.cells()), t.polygons(), ["grid_id"])
    return AR.top_two(AR.category_fractions(t.cells(), weights))


def _model_input(t: Tables) -> DataFrame:
    return M.model_input(t.bias(), _categories(t), t.census(), ["B01001_001E", "B17001_002E"])


@query
def model_input(t: Tables) -> DataFrame:
    return rounded(_model_input(t))


@query
def model_rows_for_lead(t: Tables) -> DataFrame:
    # Stored once, as the standardisation reads it twice.
    rows = materialize(_model_input(t).where(F.col("lead_time") == 24), "model-input")
    return rounded(M.design_matrix(M.ordered_for_lead(rows, G.node_table(t.polygons()), 24)))


@query
def ols_fixed_effects(t: Tables) -> DataFrame:
    rows = materialize(_model_input(t).where(F.col("lead_time") == 24), "model-input")
    return rounded(M.fixed_effects(M.design_matrix(rows)))
