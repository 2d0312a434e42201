"""Nearest as-of join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealcast.functions.timefn import epoch_seconds
from arealcast.session import materialize


#: Rows of one key beyond which its times are cut into ranges, and the ranges of such a key.
HEAVY, RANGES = 100_000, 256
#: Rows that one task sorts for its windows, about.
TASK_ROWS = 250_000


def time_ranges(rows: DataFrame, keys: Sequence[str], time: Column, heavy: int = HEAVY, ranges: int = RANGES) -> DataFrame:
    """(keys, _cuts): ascending times that cut the rows of every key with over ``heavy`` rows into about equal ranges.

    Counts find the heavy keys; only their rows enter a sketch of quantiles, of constant size per key. Light keys are
    one range and have no row here.
    """
    keys = list(keys)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(*keys)
    probs = [i / ranges for i in range(1, ranges)]
    sketch = F.percentile_approx(time, probs, F.lit(ranges * 20))
    return rows.join(large, keys, "left_semi").groupBy(*keys).agg(F.array_distinct(sketch).alias("_cuts"))


def range_number(cuts: Column, at: Column, ranges: int = RANGES) -> Column:
    """How many of the ascending ``cuts`` (at most ``ranges``, or NULL) are not above ``at``, by halving."""
    steps = [1 << k for k in reversed(range(ranges.bit_length()))]
    closer = lambda n, step: n + F.when(F.try_element_at(cuts, n + step) <= at, step).otherwise(0)
    return F.coalesce(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), closer), F.lit(0))


def asof_nearest(
    requests: DataFrame,
    observations: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    heavy: int = HEAVY,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Attach to every request the observation nearest in ``time`` with the same ``keys``.

    No tolerance; a tie goes to the later observation; of several observations at one instant the
    largest (by ``columns``) counts. Requests without any observation are dropped. Adds ``matched_time``
    and ``columns``.

    Requests and observations are gathered and written once. Where one key has very many of them, its times are cut
    into ranges of about equal numbers of rows, so that the key is spread over tasks whatever its times are. Inside a
    range a window finds the neighbours, and across ranges only each range's first and last observation travel. Both
    neighbours are running values, the following one over the descending order, so a range costs no more than its sort.
    The sorts are dealt out to as many tasks as the written rows need, so that a task's memory doesn't grow with the input.
    """
    spark = requests.sparkSession
    keys = list(keys)
    payload = F.struct(F.col(time).alias("t"), *[F.col(c) for c in columns])
    # One observation per key and instant, whatever the number of duplicates; requests travel as they are.
    seen = observations.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(payload).alias("_obs"))
    asked = requests.dropna(subset=[*keys, time]).select(*keys, time, F.struct("*").alias("_row"))
    mixed = materialize(seen.unionByName(asked, allowMissingColumns=True), "asof")
    rows = mixed.count()  # from the footers of what was written
    at = epoch_seconds(F.col(time)).cast("double")
    cuts = materialize(time_ranges(mixed, keys, at, heavy), "ranges")
    mixed = mixed.withColumn("_at", at).join(cuts, keys, "left")
    mixed = mixed.withColumn("_b", range_number(F.col("_cuts"), F.col("_at"))).drop("_cuts", "_at")

    marks = mixed.groupBy(*keys, "_b").agg(F.min("_obs").alias("_first"), F.max("_obs").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(
        *keys,
        "_b",
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_first", ignorenulls=True).over(following).alias("_after"),
    )

    is_request = F.col("_row").isNotNull()
    up = Window.partitionBy(*keys, "_b").orderBy(F.col(time), is_request).rowsBetween(Window.unboundedPreceding, 0)
    down = (
        Window.partitionBy(*keys, "_b")
        .orderBy(F.col(time).desc(), is_request)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / task_rows))
    near = (
        mixed.repartition(tasks, *keys, "_b")
        .withColumn("_prev", F.last("_obs", ignorenulls=True).over(up))
        .withColumn("_next", F.last("_obs", ignorenulls=True).over(down))
        .where(is_request)
        .join(carried, [*keys, "_b"])
        .withColumn("_prev", F.coalesce("_prev", "_before"))
        .withColumn("_next", F.coalesce("_next", "_after"))
    )
    later = F.col("_prev").isNull() | (
        (F.col("_next.t") - F.col(time)) <= (F.col(time) - F.col("_prev.t"))
    )
    chosen = F.when(F.col("_next").isNotNull() & later, F.col("_next")).otherwise(F.col("_prev"))
    first = [*keys, time]
    return (
        near.select("_row", chosen.alias("_hit"))
        .where(F.col("_hit").isNotNull())
        .select(
            *[F.col(f"_row.{c}").alias(c) for c in [*first, *[c for c in requests.columns if c not in first]]],
            F.col("_hit.t").alias("matched_time"),
            *[F.col(f"_hit.{c}").alias(c) for c in columns],
        )
    )
