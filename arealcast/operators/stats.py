"""Descriptive statistics of (possibly grouped) columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.functions import scalars as S
from arealcast.operators.ordering import profile, quantiles, value_counts, with_row_number

QUARTILES = [0.25, 0.5, 0.75]
#: Beyond so many bandwidths exp(-z * z / 2) is zero in a double.
REACH = 38.7


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, q25, q50, q75, max of ``value`` per group."""
    by = list(by)
    out = profile(value_counts(df, value, by), QUARTILES, by)
    q = [F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return out.select(*by, "count", "mean", "std", "min", *q, "max")


def mean_std(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return (
        df.dropna(subset=list(by))
        .groupBy(*by)
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    )


def season_columns(df: DataFrame, value: str, by: Sequence[str], season: str = "season") -> DataFrame:
    """Mean and sample std per group with one column pair per season."""
    cells = []
    for name in ("DJF", "MAM", "JJA", "SON"):
        x = F.when(F.col(season) == name, F.col(value))
        cells += [F.avg(x).alias(f"mean_{name.lower()}"), F.stddev_samp(x).alias(f"std_{name.lower()}")]
    return df.groupBy(*by).agg(*cells)


def shared_histogram(
    df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 30, density: bool = False
) -> DataFrame:
    """Counts over one set of bins common to all groups: the value range padded by 2 %.

    Bins are closed on the left, the last one on both sides. Empty bins are listed with zero.
    """
    by = list(by)
    v = F.col(value)
    span = F.max(v) - F.min(v)
    pad = F.when(span == 0, 0.1).otherwise(span * 0.02)
    edges = df.agg(F.struct((F.min(v) - pad).alias("lo"), (F.max(v) + pad).alias("hi")).alias("e")).scalar()
    rows = df.where(v.isNotNull()).withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    index = F.least(F.floor((v - F.col("_e.lo")) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # One map per group, at most one entry per bin.
    table = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_total")
    )
    out = table.withColumn("_e", edges).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0).cast("long"))
    columns = [
        *by,
        "bin",
        (F.col("_e.lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_e.lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        n.alias("n"),
    ]
    if density:
        columns.append((n / (F.col("_total") * width)).alias("density"))
    return out.select(*columns)


def box_stats(df: DataFrame, value: str, by: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme data within ``whis`` times the IQR) and outlier count per group."""
    by = list(by)
    counted = value_counts(df, value, by)
    names = ("q1", "median", "q3")
    cuts = profile(counted, QUARTILES, by).select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    v = F.col("_v")
    reach = (F.col("q3") - F.col("q1")) * whis
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        counted.join(cuts, by)
        .groupBy(*by)
        .agg(
            *[F.max(c).alias(c) for c in names],
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
        )
    )


def gaussian_kde(
    df: DataFrame, value: str, by: Sequence[str], gridsize: int = 200, cut: float = 3.0, common_norm: bool = False
) -> DataFrame:
    """Gaussian kernel density per group on ``gridsize`` points reaching ``cut`` bandwidths past the data.

    Bandwidth is n^(-1/5) times the sample std. Equal values are counted once, and each meets only the grid points where its
    kernel is not zero in a double: those within ``REACH`` bandwidths. Value counts and the groups' moments come from one
    pass, and the kernel sums are partial aggregates, so only grid points are shuffled. ``common_norm`` scales each group by
    its share of all rows.
    """
    by = list(by)
    v = F.col(value).cast("double")
    keep = v.isNotNull() & ~F.isnan(v)
    for key in by:
        keep = keep & F.col(key).isNotNull()
    # One pass for both: a row per distinct value, and a row per group, whose spread is merged from means and squares.
    rows = df.where(keep).select(*by, v.alias("_v"), v.alias("_x"))
    both = rows.groupingSets([[F.col(c) for c in (*by, "_v")], [F.col(c) for c in by]], *by, "_v").agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("_x").alias("_std"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        F.grouping("_v").alias("_all"),
    )
    counted = both.where("_all = 0").select(*by, "_v", "_n")
    n = F.col("_n")
    scale = both.where("_all = 1").select(
        *by, n.alias("_total"), (F.col("_std") * F.pow(n, F.lit(-0.2))).alias("_h"), "_lo", "_hi"
    ).where(F.col("_h") > 0)
    h = F.col("_h")
    lo, hi = F.col("_lo") - h * cut, F.col("_hi") + h * cut
    step = (hi - lo) / (gridsize - 1)
    point = lo + F.col("grid_index") * step
    last = F.lit(gridsize - 1)
    near = lambda x: F.least(last, F.greatest(F.lit(0), F.floor((x - lo) / step).cast("int")))
    z = (F.col("x") - F.col("_v")) / h
    norm = F.col("_total")
    if common_norm:
        norm = counted.agg(F.sum("_n")).scalar()
    reached = (
        counted.join(scale, by)
        .withColumn("grid_index", F.explode(F.sequence(near(F.col("_v") - h * REACH), F.least(last, near(F.col("_v") + h * REACH) + 1))))
        .withColumn("x", point)
        .groupBy(*by, "grid_index", "x", "_total", "_h")
        .agg(F.sum(F.col("_n") * F.exp(-(z * z) / 2)).alias("_k"))
    )
    density = (F.col("_k") / (norm * h * F.sqrt(2 * F.pi()))).alias("density")
    found = reached.select(*by, "grid_index", "x", density)
    # Grid points that no value reaches have density zero.
    every = scale.withColumn("grid_index", F.explode(F.sequence(F.lit(0), last))).select(*by, "grid_index", point.alias("x"))
    sums = found.select(*by, "grid_index", "density")
    return every.join(sums, [*by, "grid_index"], "left").select(*by, "grid_index", "x", F.coalesce("density", F.lit(0.0)).alias("density"))


def quantile_vector(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row per probability, missing values ignored."""
    q = quantiles(df, value, probs)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("q").alias("value"))
    return q.select(F.explode(pairs).alias("z")).select("z.prob", "z.value")


def share_by_band(
    df: DataFrame, value: str, edges: Column, columns: Sequence[str], open_tail: bool = False
) -> DataFrame:
    """Share of each total that lies in each band of ``value``; bands are closed on both sides.

    ``edges`` is one ascending array (a literal or a scalar subquery) of at least two entries. A value on
    an inner edge counts in both bands; ``open_tail`` adds a band from the last edge upwards. Each row finds
    its bands in the array, so no join is needed.
    """
    totals = df.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("t")).scalar()
    banded = (
        df.withColumn("_edges", edges)
        .withColumn(
            "band",
            F.explode(
                F.filter(
                    F.sequence(F.lit(0), F.size("_edges") - (1 if open_tail else 2)),
                    lambda i: (F.col(value) >= F.get("_edges", i))
                    & (F.col(value) <= F.coalesce(F.get("_edges", i + 1), F.col(value))),
                )
            ),
        )
        .groupBy("band")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .withColumn("_t", totals)
        .withColumn("_edges", edges)
    )
    return banded.select(
        "band",
        F.get("_edges", F.col("band")).alias("lo"),
        F.get("_edges", F.col("band") + 1).alias("hi"),
        *[F.try_divide(F.col(c), F.col("_t")[c]).alias(f"share_{c}") for c in columns],
    )


def fixed_width_edges(df: DataFrame, value: str, width: float) -> Column:
    """Evenly spaced edges over the whole-number range of ``value``, about ``width`` apart."""
    v = F.col(value)
    lo, hi = F.min(v).cast("long").cast("double"), F.max(v).cast("long").cast("double")
    n = F.greatest(F.ceil((F.max(v) - F.min(v)) / width).cast("int"), F.lit(2))
    return df.agg(
        F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: lo + i * ((hi - lo) / (n - 1))
        ).alias("edges")
    ).scalar()


def quantile_edges(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    return quantiles(df, value, probs).select("q").scalar()


def quartile_labels(df: DataFrame, value: str, name: str = "quartile") -> DataFrame:
    """Q1..Q4 by interpolated quantile edges, closed on the right; equal edges are an error."""
    edges = quantiles(df, value, [0.0, *QUARTILES, 1.0]).select("q").scalar()
    v, q = F.col(value), F.col("_q")
    distinct = F.size(F.array_distinct(q)) == 5
    label = (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(~distinct, F.raise_error(F.lit("quantile edges must be unique")).cast("string"))
        .when(v <= q[1], "Q1")
        .when(v <= q[2], "Q2")
        .when(v <= q[3], "Q3")
        .otherwise("Q4")
    )
    return df.withColumn("_q", edges).withColumn(name, label).drop("_q")


def rank_areas(df: DataFrame, value: str = "mean_bias", name: str = "rank") -> DataFrame:
    """Position of every area by ``value``, smallest first, ties by area id."""
    return with_row_number(df, [value, "geo_id"], name=name)


def zscore(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Standardise by mean and population std (plus a small constant) of the whole table."""
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    s = F.col("_s")
    scaled = [
        ((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + S.ZSCORE_EPSILON)).alias(f"{prefix}{c}") for c in columns
    ]
    return df.withColumn("_s", stats).select(*[F.col(c) for c in df.columns], *scaled)


def rescale(df: DataFrame, columns: Sequence[str], centre: str = "min") -> DataFrame:
    """(x - min) / range, or (x - mean) / range with ``centre='mean'``; adds ``scaled_<column>``."""
    low = F.min if centre == "min" else F.avg
    stats = df.agg(
        F.struct(
            *[low(c).alias(f"c_{c}") for c in columns],
            *[(F.max(c) - F.min(c)).alias(f"r_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    s = F.col("_s")
    scaled = [F.try_divide(F.col(c) - s[f"c_{c}"], s[f"r_{c}"]).alias(f"scaled_{c}") for c in columns]
    return df.withColumn("_s", stats).select(*[F.col(c) for c in df.columns], *scaled)


def _hash_number(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def pick_random(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct values of ``key`` in a repeatable random order."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.select(key).dropna().distinct().orderBy(digest, F.col(key)).limit(n)


def train_valid_test(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Label rows test (10 %), valid (10 % of the rest) or train by a hash of ``key``."""
    share = _hash_number(F.col(key), seed) / F.lit(float(2**32))
    label = F.when(share < 0.1, "test").when(share < 0.19, "valid").otherwise("train")
    return df.withColumn("split", label)
