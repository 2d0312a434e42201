"""File listings and tolerant scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.functions.ids import file_date
from arealcast.sources import heads


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime and length of every file below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "modificationTime", "length")
    )


def file_heads(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified and head (four bytes) of every file below ``root``; nothing else of a file is read."""
    heads.register(spark)
    return spark.read.format("file_heads").option("pattern", pattern).load(root)


def read_cells_tolerant(spark: SparkSession, root: str, schema: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """Cell files below ``root`` with their ``file``, and the paths of files that gave no row.

    Unreadable files are passed over; the second table names them, so a caller can see what is missing.
    """
    rows = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(root)
        .withColumn("file", decoded(F.input_file_name()))
    )
    return rows, skipped_files(list_files(spark, root, pattern), rows)


def decoded(uri: Column) -> Column:
    """A file's path as listings write it: rows name their file as a URI, with blanks and other characters encoded."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def skipped_files(listing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Listed files that gave no row, by file name path without scheme."""
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    seen = scanned.select(plain("file").alias("path")).distinct()
    return listing.select(plain("path").alias("path")).join(seen, "path", "left_anti")


def relay_by_month(cells: DataFrame, path: str, date: str | None = None, skip_undated: bool = False) -> None:
    """Re-lay rows into year and month folders by the date stamped in their file name.

    ``date`` (yyyyMMdd) restricts the move to one day. A file without a date stops the job unless
    ``skip_undated`` leaves such files out.
    """
    day = file_date(F.col("file"), "(?:nc|parquet)")
    if not skip_undated:
        day = F.coalesce(day, F.raise_error(F.concat(F.lit("no date in file name "), F.col("file"))).cast("date"))
    stamped = cells.withColumn("_d", day).where(F.col("_d").isNotNull())
    if date is not None:
        stamped = stamped.where(F.date_format("_d", "yyyyMMdd") == date)
    out = stamped.withColumn("year", F.year("_d")).withColumn("month", F.month("_d")).drop("_d", "file")
    (
        out.hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(path)
    )
