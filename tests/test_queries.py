"""Every registered query against its SQL on the smallest data, and the entry points' contract."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from arealcast.plans.oracles import ORACLES
from arealcast.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, folder, name):
    difference, rows, _, _ = compare.check(spark, con, folder, name)
    assert difference is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["geo_id", "lead_time", "mean_bias", "rmse", "mae", "n_obs"]
    assert df.count() == 70


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fixed_effects_against_least_squares(spark, folder):
    import numpy as np

    from arealcast.operators import model_prep as M
    from arealcast.plans.queries_stats import _model_input
    from arealcast.plans.registry import Tables
    from pyspark.sql import functions as F

    design = M.design_matrix(_model_input(Tables(spark, folder)).where(F.col("lead_time") == 24))
    rows = design.toPandas()
    terms = ["season_sin", "season_cos", "z_demo_B01001_001E", "z_demo_B17001_002E"]
    x = np.column_stack([np.ones(len(rows)), *[rows[c] for c in terms]])
    want = np.linalg.lstsq(x, rows["mean_bias"].to_numpy(), rcond=None)[0]
    got = {r.term: r.coefficient for r in M.fixed_effects(design).collect()}
    assert [got[n] for n in ["intercept", *terms]] == pytest.approx(list(want), abs=1e-6)


@pytest.mark.parametrize("name", ["cube_marginals", "lat_profile"])
def test_profiles_cover_the_wide_layout(spark, name):
    """2,000 parts lie on 40 latitudes of one grid, not on the 16 of the small grids."""
    found = entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert found.where("lat IS NOT NULL").select("lat").distinct().count() == 40


def test_completeness_counts_every_lead(spark, folder):
    """Every file on disk is one wanted pair of its date, whatever its lead."""
    found = entry.queries()["completeness_by_date"](spark, folder).agg({"n_pairs": "sum"}).first()[0]
    assert found == spark.read.parquet(f"{folder}/lineitem.parquet").select("l_linenumber", "l_shipdate").distinct().count()


def _wide_domain(spark) -> list[tuple[int, int]]:
    """Neighbours among the 100 polygons of sf0.01, counted by hand: one domain of 5 x 20 rectangles."""
    place = lambda k: (k % 5, k // 5)
    touch = lambda a, b: max(abs(x - y) for x, y in zip(place(a), place(b))) == 1
    keys = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").select("s_suppkey").collect())
    return [(a, b) for a in keys for b in keys if a < b and touch(a, b)]


def test_contiguity_edges_of_the_wide_domain(spark):
    found = entry.queries()["contiguity_edges"](spark, "/root/testdata/sf0.01")
    assert found.count() == len(_wide_domain(spark))


def test_contiguity_stats_of_the_wide_domain(spark):
    found = entry.queries()["contiguity_stats"](spark, "/root/testdata/sf0.01").first()
    assert (found.n_nodes, found.n_nonzero) == (100, 2 * len(_wide_domain(spark)))


def test_edge_energy_of_the_wide_domain(spark):
    """Every pair of the wide domain both of whose areas have a verified forecast of lead 24."""
    from arealcast.operators import verify as V
    from arealcast.plans.registry import Tables

    data = "/root/testdata/sf0.01"
    known = {int(r.geo_id) for r in V.area_mean_bias(Tables(spark, data).bias(), 24).collect()}
    want = [e for e in _wide_domain(spark) if set(e) <= known]
    assert want and entry.queries()["edge_energy"](spark, data).first().n_edges == len(want)
