"""Exact row numbers and quantiles that never sort a whole group in one task.

Row numbers come from ranges of the whole order. Quantiles first cut the value range at approximate quantiles (a
mergeable, constant-size sketch read back as a scalar subquery), count the rows of each slice, and then only order rows
inside one (key, slice) group. A slice holds about 1/``splits`` of the distinct values, so a key that
owns a third of all rows is still spread over many tasks, and the answers stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.session import materialize


# Slices per ordering; a power of two, at least 2.
SPLITS = 256


def _cuts(df: DataFrame, code: Column, splits: int) -> Column:
    """Scalar subquery: the ``splits - 1`` slice borders of ``code``."""
    probs = [i / splits for i in range(1, splits)]
    return df.agg(F.percentile_approx(code, probs, F.lit(splits * 10)).alias("cuts")).scalar()


def _with_slice(df: DataFrame, code: Column, cuts: Column, splits: int) -> DataFrame:
    """Add ``_cuts`` and ``_slice``, the number of borders below ``code``.

    The border list is halved step by step; ``splits`` is a power of two.
    """
    steps = [1 << k for k in reversed(range(splits.bit_length() - 1))]
    located = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.element_at("_cuts", at + step) < F.col("_code"), step).otherwise(0),
    )
    return (
        df.withColumns({"_cuts": cuts, "_code": code})
        .withColumn("_slice", F.coalesce(located, F.lit(0)))
        .drop("_code")
    )


def dealt_by_range(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in as many sorted ranges of the tuple ``order`` as the session has shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def with_row_number(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """1-based position by ``order`` (ascending, NULL first) within ``keys``.

    ``order`` must identify a row within its key, otherwise ties are numbered in any order. The rows are dealt into ranges
    of the whole tuple (keys, order), so equal first values spread over as many tasks as any others. Each range is sorted and
    written once with the positions of its rows; a row's number is its position plus the sizes of the ranges before.
    """
    keys = list(keys)
    at = F.monotonically_increasing_id()  # number of the range in the upper bits, position in the lower 33
    placed = materialize(dealt_by_range(df, [*keys, *order]).withColumn("_at", at), "row-numbers")
    part = F.shiftright("_at", 33)
    # One row per range, so this small map is a bounded scalar subquery.
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    entries = sizes.agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("e"))
    before = lambda i: F.aggregate(F.slice("e", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    offsets = entries.select(F.map_from_entries(F.transform("e", lambda x, i: F.struct(x["p"], before(i)))).alias("m"))
    row = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.withColumn(name, F.element_at(offsets.scalar(), part) + row)
    if keys:
        first = numbered.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(name).alias("_first"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        numbered = numbered.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1)
    return numbered.select(*df.columns, F.col(name).cast("long").alias(name))


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``_v`` and ``_n``: every distinct value with its count; NULL, NaN and NULL keys are left out."""
    v = F.col(value).cast("double")
    # Plain IS NOT NULL tests are the ones the optimizer would infer for the joins below; stating them here
    # keeps all uses of the result identical, so its shuffle is built once and reused.
    keep = v.isNotNull() & ~F.isnan(v)
    for key in keys:
        keep = keep & F.col(key).isNotNull()
    return df.where(keep).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def profile(
    counted: DataFrame, probs: Sequence[float], keys: Sequence[str] = (), splits: int = SPLITS
) -> DataFrame:
    """Exact quantiles and moments of a ``value_counts`` table.

    Gives ``keys``, ``q`` (linear-interpolated quantiles aligned with ``probs``), count, mean, std (sample),
    min and max. Every pass reads the same shuffled counts.
    """
    keys = list(keys)
    # The count stays referenced so that the sketch reads the same shuffle as the other passes.
    code = F.when(F.col("_n") > 0, F.col("_v"))
    sliced = _with_slice(counted, F.col("_v"), _cuts(counted, code, splits), splits)

    # One row per key and slice, at most splits rows per key. Squares are taken from a border of the slice,
    # so values far from zero do not cancel.
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    n, total = F.col("_n"), F.col("_total")
    d = F.col("_v") - F.element_at("_cuts", F.greatest("_slice", F.lit(1)))
    slices = (
        sliced.groupBy(*keys, "_slice")
        .agg(
            F.sum(n).alias("_size"),
            F.sum(n * F.col("_v")).alias("_sum"),
            F.greatest(F.sum(n * d * d) - F.sum(n * d) * F.sum(n * d) / F.sum(n), F.lit(0.0)).alias("_m2"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
        .select(
            "*",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.sum("_size").over(per_key).alias("_total"),
            (F.sum("_sum").over(per_key) / F.sum("_size").over(per_key)).alias("_mean"),
        )
    )
    gap = F.col("_sum") / F.col("_size") - F.col("_mean")
    spread = F.sum(F.col("_m2") + F.col("_size") * gap * gap).over(per_key)
    position = lambda p: F.lit(float(p)) * (total - 1)
    ranks = F.array_distinct(
        F.array(*[f(position(p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    )
    summary = {
        "_total": total,
        "_mean": F.col("_mean"),
        "_spread": spread,
        "_low": F.min("_min").over(per_key),
        "_high": F.max("_max").over(per_key),
    }
    wanted = slices.select(
        *keys,
        "_slice",
        "_before",
        *[c.alias(name) for name, c in summary.items()],
        F.filter(
            ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size"))
        ).alias("_ranks"),
    ).where(F.size("_ranks") > 0)

    run = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_end")
    picked = (
        sliced.drop("_cuts")
        .join(wanted, [*keys, "_slice"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(run))
        .withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= end - n) & (r < end))))
    )
    # At most two ranks per probability remain.
    found = picked.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"),
        *[F.max(name).alias(name) for name in summary],
    )
    at = F.col("_at")

    def interpolate(p: float) -> Column:
        pos = position(p)
        lo = F.try_element_at(at, F.floor(pos).cast("long"))
        hi = F.try_element_at(at, F.ceil(pos).cast("long"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    return found.where(total.isNotNull()).select(
        *keys,
        F.array(*[interpolate(p) for p in probs]).alias("q"),
        total.alias("count"),
        F.col("_mean").alias("mean"),
        F.when(total > 1, F.sqrt(F.col("_spread") / F.nullif(total - 1, F.lit(0)))).alias("std"),
        F.col("_low").alias("min"),
        F.col("_high").alias("max"),
    )


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), splits: int = SPLITS
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``keys`` and ``q`` (array aligned with ``probs``)."""
    return profile(value_counts(df, value, keys), probs, keys, splits).select(*keys, "q")
