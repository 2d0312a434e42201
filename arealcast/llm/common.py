"""Helpers shared by the text operators.

Rules that hold for every operator here, unless its docstring says otherwise:

* a null text is an empty text; a null id is an id like any other and is returned as null;
* only the named columns are read, so extra columns with any name are harmless;
* rows that repeat are kept, each with its own result; an empty table gives an empty result of the same schema;
* texts are read whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.session import materialize

#: Fixed by the queries' contracts: runs of characters other than ASCII white space, and alphanumeric words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z of a text whose other characters matter only as being no ASCII letter.

    ``lower`` also changes other letters, but the Kelvin sign is the only one that it turns into an ASCII letter alone,
    so texts with that sign take the slower way.
    """
    return F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def alnum_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, lower-cased; an empty array for null."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM, " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def unused_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Rows of one Arrow batch to a Python worker where texts are sent: a bound on the worker's memory, not on results.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of at most ``BATCH_ROWS`` rows from now on."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS or int(spark.conf.get(setting)) <= 0:
        spark.conf.set(setting, str(BATCH_ROWS))


def materialize_lean(df: DataFrame, purpose: str) -> DataFrame:
    """``materialize``, with the shuffle files of the job given up as soon as its table is written."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    bound_batches(spark)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        return materialize(df, purpose)
    finally:
        spark.conf.set(setting, before)


#: Bytes up to which a written table is sent to every task of a join; larger ones are left to Spark, which shuffles both sides.
SENT_BYTES = 32 << 20


def sent_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows, counted from the footers, take at most ``SENT_BYTES``.

    For the few ids that say which texts go on: with them at every task no text has to move.
    """
    return F.broadcast(table) if table.count() * row_bytes <= SENT_BYTES else table
