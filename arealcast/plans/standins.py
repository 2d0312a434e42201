"""The domain tables, derived from the driver's tables.

Every view reads whole tables and grows with them. Cells are laid out in grids of 16 x 50 cells, and
polygons in domains of 5 x 2 rectangles, so that even small tables give several grids of equal axes; a
grid is covered by the polygon domain of the same number. Where the job is as large as the axes
(marginals, profiles, neighbours), the wide layout is taken: grids of 400 x 50 cells and domains of
5 x 49 rectangles, whose latitudes stay on the globe however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.operators.spatial import rectangle_ring

# First model starts with the data, second model later.
SECOND_START = "1998-01-01"
# Layout of the stand-in grid.
LAT0, LON0, STEP, GRID_ROWS, GRID_COLS = 0.0, -125.0, 0.125, 16, 50
GRID_CELLS = GRID_ROWS * GRID_COLS
WIDE_CELLS = 400 * GRID_COLS
POLY_COLS, POLY_ROWS = 5, 2
WIDE_POLY_ROWS = 49


class StandIns:
    """Lazy stand-in views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _area_id(key: str):
        k = F.col(key).cast("string")
        return F.when(F.length(k) < 5, F.lpad(k, 5, "0")).otherwise(k).alias("geo_id")

    @property
    def t2m(self):
        return 273.15 + F.col("l_quantity")

    @property
    def t2m_second(self):
        return 273.15 + 0.9 * F.col("l_quantity") + 10.0 * F.col("l_discount")

    def forecasts(self, second: bool = False) -> DataFrame:
        li = self.raw("lineitem")
        if second:
            li = li.where(F.col("l_shipdate") >= F.lit(SECOND_START).cast("timestamp_ntz"))
        lead = F.col("l_linenumber") * 24
        return (
            li.groupBy("l_suppkey", "l_shipdate", "l_linenumber")
            .agg(F.avg(self.t2m_second if second else self.t2m).alias("t2m"))
            .select(
                self._area_id("l_suppkey"),
                F.col("l_shipdate").alias("valid_time"),
                (F.col("l_shipdate") - F.make_dt_interval(F.lit(0), lead)).alias("init_time"),
                lead.alias("lead_time"),
                "t2m",
            )
        )

    def forecast_slots(self) -> DataFrame:
        """Start and lead of all forecasts there are, as the names of their files tell them."""
        slots = self.raw("lineitem").select("l_shipdate", (F.col("l_linenumber") * 24).alias("lead_time")).distinct()
        return slots.select((F.col("l_shipdate") - F.make_dt_interval(F.lit(0), F.col("lead_time"))).alias("init_time"), "lead_time")

    def analyses(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_suppkey", "o_orderdate")
            .agg(F.avg(self.t2m).alias("t2m"))
            .select(self._area_id("l_suppkey"), F.col("o_orderdate").alias("time"), "t2m")
        )

    def area(self) -> DataFrame:
        """The polygon attribute table as delivered: id, state and land area in square metres."""
        return self.raw("supplier").select(
            self._area_id("s_suppkey"), F.col("s_nationkey").alias("statefp"), (1e6 * (100 + F.abs("s_acctbal"))).alias("aland_m2")
        )

    def land_area(self) -> DataFrame:
        return self.area().select("geo_id", (F.col("aland_m2") / 1e6).alias("aland"))

    def _cell_place(self, key: str, cells: int = GRID_CELLS) -> dict:
        n = F.col(key) % cells
        return {
            "grid_id": F.floor(F.col(key) / cells).cast("int"),
            "lat": LAT0 + STEP * F.floor(n / GRID_COLS),
            "lon": LON0 + STEP * (n % GRID_COLS),
        }

    def cells(self) -> DataFrame:
        k = F.col("p_partkey")
        place = self._cell_place("p_partkey")
        return self.raw("part").select(
            *[v.alias(n) for n, v in place.items()],
            F.when(k % 37 != 0, 250.0 + F.col("p_size")).alias("value"),
            F.when(k % 41 != 0, F.col("p_size") % 6).cast("int").alias("category"),
        )

    def cell_observations(self, wide: bool = False) -> DataFrame:
        place = self._cell_place("l_partkey", WIDE_CELLS if wide else GRID_CELLS)
        hours = F.make_dt_interval(F.lit(0), 3 * F.col("l_linenumber"))
        return self.raw("lineitem").select(
            *[v.alias(n) for n, v in place.items()],
            (F.col("l_shipdate") + hours).alias("time"),
            self.t2m.alias("f"),
            self.t2m_second.alias("a"),
            (270.0 + 10.0 * F.col("l_tax")).alias("c"),
            (F.col("l_linenumber") * 24).alias("lead_time"),
        )

    def polygons(self, wide: bool = False) -> DataFrame:
        k, size = F.col("s_suppkey"), POLY_COLS * (WIDE_POLY_ROWS if wide else POLY_ROWS)
        n = k % size
        col, row = n % POLY_COLS, F.floor(n / POLY_COLS)
        x = lambda c: -125.2 + 1.27 * c
        y = lambda r: -0.1 + 1.03 * r
        return self.raw("supplier").select(
            self._area_id("s_suppkey"),
            F.floor(k / size).cast("int").alias("grid_id"),
            F.col("s_nationkey").alias("statefp"),
            rectangle_ring(x(col), x(col + 1), y(row), y(row + 1)).alias("rings"),
        )

    def census(self) -> DataFrame:
        """Wide census table with a sentinel, a margin and an annotation column."""
        qty = F.sum("l_quantity")
        returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
        income = F.when(F.col("l_suppkey") % 17 == 0, -666666666.0).otherwise(F.max("l_extendedprice"))
        grouped = self.raw("lineitem").groupBy("l_suppkey").agg(
            qty.alias("B01001_001E"),
            F.count(F.lit(1)).cast("double").alias("B01001_001M"),
            qty.alias("B17001_001E"),
            returned.alias("B17001_002E"),
            income.alias("B19013_001E"),
        )
        return grouped.select(
            self._area_id("l_suppkey"),
            F.concat(F.lit("Area "), F.col("l_suppkey").cast("string")).alias("NAME"),
            "B01001_001E",
            "B01001_001M",
            "B17001_001E",
            "B17001_002E",
            "B19013_001E",
            F.lit(None).cast("string").alias("B19013_001EA"),
        )

    def files(self) -> DataFrame:
        """Forecast file paths. The date is read from an aggregate so that path filters stay above it."""
        day = F.date_format(F.max("l_shipdate"), "yyyyMMdd")
        lead = (F.col("l_linenumber") * 24).cast("string")
        return (
            self.raw("lineitem")
            .groupBy("l_linenumber", "l_shipdate")
            .agg(day.alias("_day"))
            .select(
                F.concat(
                    F.lit("/fc/0.125/2t/0000/"), lead, F.lit("/m1_fc_2t_0000_"), lead, F.lit("_"), "_day", F.lit(".nc")
                ).alias("path")
            )
        )

    def analysis_files(self) -> DataFrame:
        day = F.date_format(F.max("o_orderdate"), "yyyyMMdd")
        return (
            self.raw("orders")
            .groupBy("o_orderdate")
            .agg(day.alias("_day"))
            .select(F.concat(F.lit("/an/0.125/2t/m1_an_2t_"), "_day", F.lit(".nc")).alias("path"))
        )

