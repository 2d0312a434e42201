"""Reading and writing of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast import schemas
from arealcast.operators.spatial import rings_from_wkt, wkt_from_rings
from arealcast.sources.published import current, publish, resolve


def read_if_present(spark: SparkSession, *paths: str) -> DataFrame | None:
    """Parquet scan of published tables or plain folders, or None when nothing is there. Only footers are looked at."""
    try:
        return spark.read.parquet(*[resolve(spark, p) for p in paths])
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table, or a plain Parquet folder."""
    return spark.read.parquet(resolve(spark, path))


def read_nanos(spark: SparkSession, path: str, times: Sequence[str]) -> DataFrame:
    """Parquet files with nanosecond timestamps, as data-frame libraries write them.

    The columns ``times`` become TIMESTAMP_NTZ. Only the columns that ``spark.sql.legacy.parquet.nanosAsLong`` concerns need
    that setting, and Spark reads it when a plan runs: a session without it gets an error that names it.
    """
    if spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") != "true":
        raise ValueError("set spark.sql.legacy.parquet.nanosAsLong to true to read nanosecond timestamps")
    df = spark.read.parquet(path)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def whole(x: Column, by: int) -> Column:
        """Integer division rounding down, exact for every BIGINT."""
        return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))

    def convert(name: str) -> Column:
        micros = whole(F.col(name), 1000)
        seconds = whole(micros, 1_000_000)
        rest = (micros - seconds * 1_000_000).cast("decimal(7,0)") / F.lit(1_000_000).cast("decimal(7,0)")
        span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds + rest).cast("decimal(18,6)"))
        return (epoch + span).alias(name)

    longs = {n for n, t in df.dtypes if t == "bigint"}
    return df.select(*[convert(c) if c in times and c in longs else F.col(c) for c in df.columns])


def table_is_valid(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> bool:
    """Whether a readable table with the wanted columns is at ``path``; no data is scanned.

    Of a published table the manifest tells the columns, and its files have to be there.
    """
    manifest = current(spark, path)
    if manifest is not None and not set(columns) <= set(manifest.columns):
        return False
    df = read_if_present(spark, path)
    return df is not None and set(columns) <= set(df.columns)


def write_table(df: DataFrame, path: str, kind: str, force: bool = False) -> bool:
    """Publish one output table unless a valid one exists. Returns whether it was written.

    A rewrite that fails leaves the table as it was. A metadata file with types and units is written beside it.
    """
    spark = df.sparkSession
    if not force and table_is_valid(spark, path, schemas.TABLES[kind]):
        return False
    publish(schemas.conform(df, kind), path)
    write_metadata(spark, path, kind)
    return True


def metadata_row(spark: SparkSession, kind: str) -> DataFrame:
    """One row of JSON text: the table kind, and type and unit of its columns."""
    variables = {
        name: {"type": schemas.COLUMNS[name][0].simpleString(), "units": schemas.COLUMNS[name][1]}
        for name in schemas.TABLES[kind]
    }
    kind_type = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("variables", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
        ]
    )
    row = spark.createDataFrame([(kind, variables)], kind_type)
    return row.select(F.to_json(F.struct("kind", "variables")).alias("value"))


def write_metadata(spark: SparkSession, path: str, kind: str) -> None:
    publish(metadata_row(spark, kind).coalesce(1), metadata_path(path), "text")


def metadata_path(path: str) -> str:
    return path.removesuffix(".parquet") + ".meta.json"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata row (value) of the table at ``path``."""
    return spark.read.text(resolve(spark, metadata_path(path)))


def consolidate(spark: SparkSession, chunks: str, path: str, kind: str) -> None:
    """One table from a chunk directory, cast to the declared schema."""
    publish(schemas.conform(spark.read.parquet(chunks), kind), path)
    write_metadata(spark, path, kind)


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header; ids have to be declared STRING so that leading zeros stay."""
    paths = [resolve(spark, p) for p in ([path] if isinstance(path, str) else path)]
    return spark.read.csv(paths, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    publish(df, path, "csv", header="true")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon layer from CSV with GEOID, STATEFP, ALAND and a WKT column."""
    raw = read_csv(spark, path, "GEOID string, STATEFP string, ALAND double, WKT string")
    return raw.select(
        F.col("GEOID").alias("geo_id"),
        F.col("STATEFP").alias("statefp"),
        F.col("ALAND").alias("aland_m2"),
        rings_from_wkt(F.col("WKT")).alias("rings"),
    )


def write_map_layer(polygons: DataFrame, attributes: DataFrame, path: str, keep_empty: bool = True) -> None:
    """Polygons with attributes as CSV with a WKT column."""
    joined = polygons.join(attributes, "geo_id", "left" if keep_empty else "inner")
    rest = [c for c in joined.columns if c != "rings"]
    write_csv(joined.select(*rest, wkt_from_rings(F.col("rings")).alias("WKT")), path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Gridded fields partitioned by month of their time, published as a whole."""
    out = cells.withColumn("year", F.year("time")).withColumn("month", F.month("time"))
    publish(out.hint("rebalance", "year", "month"), path, partition_by=["year", "month"])
