"""Numeric column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
KELVIN_OFFSET = 273.15
STANDARD_GRAVITY = 9.80665
ZSCORE_EPSILON = 1e-8


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def negative_to_null(x: Column) -> Column:
    """Sentinel codes of the census tables are negative; real values never are."""
    return F.when(x >= 0, x)


def bias(fc: Column, an: Column) -> Column:
    return fc - an


def kelvin_to_celsius(x: Column) -> Column:
    return x - KELVIN_OFFSET


def m2_to_km2(x: Column) -> Column:
    return x.cast("double") / 1e6


def geopotential_height(z: Column) -> Column:
    return z / STANDARD_GRAVITY


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(part, total) * 100


def ratio(part: Column, total: Column) -> Column:
    return F.try_divide(part, total)


def population_density(population: Column, area: Column) -> Column:
    return F.try_divide(population, area) / 1000


def annual_sin(doy: Column) -> Column:
    return F.sin(2 * math.pi * doy / 365)


def annual_cos(doy: Column) -> Column:
    return F.cos(2 * math.pi * doy / 365)


def cyclic_sin01(x: Column, period: float) -> Column:
    return (F.sin(x / period * (2 * math.pi)) + 1) / 2


def cyclic_cos01(x: Column, period: float) -> Column:
    return (F.cos(x / period * (2 * math.pi)) + 1) / 2


def wrap_longitude(lon: Column) -> Column:
    """Degrees east in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cos_latitude(lat: Column) -> Column:
    return F.cos(F.radians(lat))
