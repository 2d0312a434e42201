"""Wide census tables: column roles come from name suffixes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Geography columns and suffix roles.
GEOGRAPHY_COLUMNS = ("NAME", "STATE", "COUNTY", "TRACT", "GEOMETRY")
ANNOTATION_SUFFIX = re.compile(r"(EA|MA)$")


def estimates_only(df: DataFrame, ids: Sequence[str] = ("geo_id",)) -> DataFrame:
    """Keep ids, geography columns and estimate columns (names ending in E, any case)."""
    geo = [c for c in df.columns if c.upper() in GEOGRAPHY_COLUMNS or c in ids]
    return df.select(*geo, *[c for c in df.columns if c.upper().endswith("E") and c not in geo])


def drop_annotations(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not ANNOTATION_SUFFIX.search(c)])


def split_estimates_and_margins(df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables with the ``keep`` columns plus the estimates (E) or margins (M), suffix removed."""

    def part(suffix: str) -> DataFrame:
        chosen = [c for c in df.columns if c not in keep and c.endswith(suffix)]
        return df.select(*keep, *[F.col(c).alias(c[:-1]) for c in chosen])

    return part("E"), part("M")


def to_long(df: DataFrame, ids: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row per id and estimate column."""
    columns = [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), columns, name, value
    )


def glue_tables(tables: Sequence[DataFrame], key: str, trailing: Sequence[str]) -> DataFrame:
    """Column-wise union of several tables on ``key``; only the last keeps its ``trailing`` columns."""
    out = tables[0].drop(*trailing) if len(tables) > 1 else tables[0]
    for i, table in enumerate(tables[1:], start=1):
        out = out.join(table if i == len(tables) - 1 else table.drop(*trailing), key)
    return out


def outer_align(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables on ``key``."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, key, "full")
    return out


def rows_from_json(df: DataFrame, payload: str, header: Sequence[str], numeric: dict[str, str]) -> DataFrame:
    """Array-of-arrays payloads (header row first) as a table.

    ``header`` names the wanted fields, looked up by position in each payload's own header row;
    ``numeric`` maps numeric fields to their output names (text that is no number becomes NULL).
    """
    parsed = df.withColumn("_rows", F.from_json(payload, "array<array<string>>"))
    cells = (
        parsed.withColumn("_head", F.get("_rows", F.lit(0)))
        .select("_head", F.posexplode("_rows").alias("_i", "_row"))
        .where(F.col("_i") > 0)
    )

    def field(name: str):
        at = F.array_position("_head", name)
        text = F.when(at > 0, F.try_element_at("_row", at.cast("int")))
        if name in numeric:
            return text.try_cast("double").alias(numeric[name])
        return text.alias(name)

    return cells.select(*[field(n) for n in header])
