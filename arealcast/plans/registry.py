"""Registry of named queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.operators import climatology as C
from arealcast.operators import verify as V
from arealcast.plans.standins import StandIns

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables(StandIns):
    """Stand-ins plus the derived tables that many queries start from."""

    def bias(self, second: bool = False) -> DataFrame:
        return V.bias_table(self.forecasts(second), self.analyses(), self.land_area())

    def climatology(self) -> DataFrame:
        return C.climatology(C.drop_leap_days(self.analyses()))

    def anomalies(self) -> DataFrame:
        return V.anomaly_table(self.bias(), self.climatology())


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register ``fn`` under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the given columns (all DOUBLE ones by default) so that sums in another order compare equal.

    Rounding to nine digits first removes the noise that would decide a tie at the last digit kept; the second
    step is spelled out so that every engine does the same arithmetic.
    """
    names: Sequence[str] = columns or [n for n, t in df.dtypes if t == "double"]
    unit = 10.0**DIGITS
    return df.select(
        *[
            (F.floor(F.round(c, DIGITS + 3) * unit + 0.5) / unit).alias(c) if c in names else F.col(c)
            for c in df.columns
        ]
    )
