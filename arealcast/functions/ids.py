"""Identifier and file-name expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of the state, county and tract parts of an area id.
STATE_DIGITS, COUNTY_DIGITS, TRACT_DIGITS = 2, 3, 6
# Date stamp in a gridded file name.
FILE_DATE_PATTERN = r"_(\d{8})(?:\D.*)?\.{ext}$"
# Name of a chunk file.
CHUNK_PATTERN = r"([a-z]+_(?:fc|an))_2t_county_(\d{4})_(\d{2})(?:_lead(\d+))?\.parquet$"


def zfill(s: Column, width: int) -> Column:
    """Left-pad with zeros, never truncating a longer value."""
    s = s.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def county_id(state: Column, county: Column) -> Column:
    return F.concat(zfill(state, STATE_DIGITS), zfill(county, COUNTY_DIGITS))


def tract_id(state: Column, county: Column, tract: Column) -> Column:
    return F.concat(county_id(state, county), zfill(tract, TRACT_DIGITS))


def normalize_county_id(s: Column) -> Column:
    return zfill(s, STATE_DIGITS + COUNTY_DIGITS)


def id_tail(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def file_date(path: Column, ext: str = "nc") -> Column:
    """Date stamped in a file name, NULL when the name does not match. ``ext`` may be ``(?:nc|grib)``."""
    digits = F.regexp_extract(path, FILE_DATE_PATTERN.replace("{ext}", ext), 1)
    return F.try_to_date(digits, "yyyyMMdd")


def chunk_parts(name: Column) -> list[Column]:
    """tag, year, month and lead of a chunk file name (lead NULL for analyses)."""
    part = lambda i: F.nullif(F.regexp_extract(name, CHUNK_PATTERN, i), F.lit(""))
    return [
        part(1).alias("tag"),
        part(2).cast("int").alias("year"),
        part(3).cast("int").alias("month"),
        part(4).cast("int").alias("lead_time"),
    ]


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    """The first of ``names`` that ``df`` has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(names)} in columns {df.columns}")


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project to ``names`` in their order, passing over the ones ``df`` lacks."""
    return df.select(*[c for c in names if c in df.columns])
