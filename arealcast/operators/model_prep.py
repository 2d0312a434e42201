"""Assembly of model input: bias by day of year, climate class, census covariates, fixed effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.functions.ids import first_present, normalize_county_id
from arealcast.operators.stats import zscore
from arealcast.operators.verify import doy_lead_bias

# Fixed value: name prefix of census covariates in the model input.
COVARIATE_PREFIX = "demo_"
# Share of its own square sum that a term must keep beside the earlier terms to enter a fit.
DEPENDENT = 1e-12


def model_input(
    bias: DataFrame, categories: DataFrame | None, census: DataFrame, covariates: Sequence[str]
) -> DataFrame:
    """Mean bias per area, lead and calendar day with climate class and prefixed census covariates."""
    rows = doy_lead_bias(bias).withColumn("geo_id", normalize_county_id(F.col("geo_id")))
    if categories is None:
        rows = rows.withColumn("koppen_class", F.lit(None).cast("int"))
    else:
        rows = rows.join(
            categories.select("geo_id", F.col("category_1").alias("koppen_class")), "geo_id", "left"
        )
    key = first_present(census, ["geo_id", "GEOID"])
    chosen = census.select(
        normalize_county_id(F.col(key)).alias("geo_id"),
        *[F.col(c).alias(f"{COVARIATE_PREFIX}{c}") for c in covariates],
    )
    return rows.join(chosen, "geo_id", "left")


def ordered_for_lead(rows: DataFrame, nodes: DataFrame, lead: int) -> DataFrame:
    """Rows of one lead time whose area is in the graph, sorted by node."""
    return rows.where(F.col("lead_time") == lead).join(nodes, "geo_id").orderBy("node_idx", "day_of_year")


def design_matrix(rows: DataFrame) -> DataFrame:
    """Add annual harmonics and standardised covariates."""
    covariates = [c for c in rows.columns if c.startswith(COVARIATE_PREFIX)]
    out = rows.withColumn("season_sin", S.annual_sin(F.col("day_of_year"))).withColumn(
        "season_cos", S.annual_cos(F.col("day_of_year"))
    )
    return zscore(out, covariates) if covariates else out


def fixed_effects(design: DataFrame, response: str = "mean_bias") -> DataFrame:
    """Ordinary least squares of ``response`` on the harmonics and standardised covariates.

    The normal equations are summed in one pass and solved by elimination on the single row of sums. One row per
    term; a term that the earlier ones explain fully is left out of the fit and gets NULL, as do all without rows.
    """
    terms = ["season_sin", "season_cos", *[c for c in design.columns if c.startswith("z_")]]
    rows = design.select(response, *terms).dropna()
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in terms]]
    y = F.col(response).cast("double")
    sums = rows.agg(F.array(*[F.array(*[F.sum(a * b) for b in [*x, y]]) for a in x]).alias("m"))

    def eliminate(m: Column, k: Column) -> Column:
        pivot = m[k][k]
        start = F.col("m")[k][k]
        lead = F.transform(m[k], lambda v: v / pivot)
        cleared = F.transform(
            m,
            lambda row, i: F.when(i == k, lead).otherwise(
                F.transform(row, lambda v, j: v - row[k] * lead[j])
            ),
        )
        return F.when(pivot > start * DEPENDENT, cleared).otherwise(F.transform(m, lambda row, i: F.when(i != k, row)))

    n = len(x)
    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.col("m"), eliminate)
    names = F.array(F.lit("intercept"), *[F.lit(c) for c in terms])
    pairs = F.arrays_zip(names.alias("term"), F.transform(solved, lambda row: row[n]).alias("coefficient"))
    return sums.select(F.inline(pairs))
