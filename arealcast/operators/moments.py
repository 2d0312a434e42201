"""Weighted means and centred second moments in one pass, by parts that can be merged.

Every task reduces its rows to one row per group: weight, means, and products centred on those means. Two such rows merge
to the row of both exactly as if their values had been centred on the common mean, so nothing is lost to cancellation
however far the values lie from zero, and only one row per group and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds before it reduces them; parts of a group that are merged in one list at most, per level.
HELD, SPREAD = 1 << 19, 64
FIELDS = ["n", "w", "mx", "my", "sxx", "sxy", "syy", "x0", "x1", "y0", "y1"]


def _reduce(code: np.ndarray, groups: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of every group of rows; the means are taken first."""
    total = np.bincount(code, w, groups)
    some = np.where(total == 0, 1.0, total)
    # Shifted by one value of the group, so that the means themselves are exact to the last digits.
    first = np.zeros(groups, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    mx = x[first] + np.bincount(code, w * (x - x[first][code]), groups) / some
    my = y[first] + np.bincount(code, w * (y - y[first][code]), groups) / some
    dx, dy = x - mx[code], y - my[code]
    out = {"n": np.bincount(code, minlength=groups), "w": total, "mx": mx, "my": my}
    out |= {"sxx": np.bincount(code, w * dx * dx, groups), "sxy": np.bincount(code, w * dx * dy, groups), "syy": np.bincount(code, w * dy * dy, groups)}
    for name, v, pick, start in (("x0", x, np.minimum, np.inf), ("x1", x, np.maximum, -np.inf), ("y0", y, np.minimum, np.inf), ("y1", y, np.maximum, -np.inf)):
        out[name] = np.full(groups, start)
        pick.at(out[name], code, v)
    return out


def _parts(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def part() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            at = pa.array(np.arange(rows.num_rows))
            named = rows.select(list(keys)).append_column("_at", at)
            groups = named.group_by(list(keys)).aggregate([("_at", "min")])
            # Number every row by the first row of its group.
            own = named.join(groups, list(keys)) if keys else named.append_column("_at_min", pa.array(np.zeros(rows.num_rows, np.int64)))
            order = np.argsort(own["_at"].to_numpy())
            first = own["_at_min"].to_numpy()[order]
            distinct, code = np.unique(first, return_inverse=True)
            x, y, w = (pc.cast(rows[c], pa.float64()).to_numpy() for c in ("_x", "_y", "_w"))
            found = _reduce(code, len(distinct), x, y, w)
            columns = [rows[k].take(pa.array(distinct)) for k in keys]
            columns += [pa.array(found[f], pa.int64() if f == "n" else pa.float64()) for f in FIELDS]
            yield from pa.table(columns, [*keys, *FIELDS]).to_batches()

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                yield from part()
                held, size = [], 0
        if held:
            yield from part()

    return run


def _merged(parts: Column) -> Column:
    """One part out of a list of at least one."""

    def merge(a: Column, b: Column) -> Column:
        w = a["w"] + b["w"]
        share = F.coalesce(F.try_divide(b["w"], w), F.lit(0.0))
        dx, dy, both = b["mx"] - a["mx"], b["my"] - a["my"], a["w"] * share
        fields = {
            "n": a["n"] + b["n"],
            "w": w,
            "mx": a["mx"] + dx * share,
            "my": a["my"] + dy * share,
            "sxx": a["sxx"] + b["sxx"] + dx * dx * both,
            "sxy": a["sxy"] + b["sxy"] + dx * dy * both,
            "syy": a["syy"] + b["syy"] + dy * dy * both,
            **{c: F.least(a[c], b[c]) for c in ("x0", "y0")},
            **{c: F.greatest(a[c], b[c]) for c in ("x1", "y1")},
        }
        return F.struct(*[fields[f].alias(f) for f in FIELDS])

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), merge)


def weighted_moments(df: DataFrame, x: str, y: str, weight: str, by: Sequence[str]) -> DataFrame:
    """``by`` and ``m``: count, weight, means, centred products sxx, sxy, syy and the ranges of x and y per group.

    Rows with a NULL or NaN in any of the columns are left out. The input is read once; a hot group is one row per task from
    then on, and its rows are merged in two levels.
    """
    keys = list(by)
    rows = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(weight).alias("_w")).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{f} {'bigint' if f == 'n' else 'double'}" for f in FIELDS]])
    parts = rows.mapInArrow(_parts(keys), schema).select(*keys, F.struct(*FIELDS).alias("p"), (F.spark_partition_id() % SPREAD).alias("_s"))
    some = parts.groupBy(*keys, "_s").agg(_merged(F.collect_list("p")).alias("p"))
    return some.groupBy(*keys).agg(_merged(F.collect_list("p")).alias("m"))
