"""Checkpointed chunk tables: one Hive partition per (year, month) or (year, month, lead_time).

Beside the partitions lies a ledger, ``_ledger``: a published table with one row per finished chunk, its number of rows and
the stamp of the source it was built from. A chunk is entered only when its files are committed, so a job that stops half
way leaves chunks that the ledger does not know and that are built again. What is finished, and what has become stale, is
read from the ledger alone, never from the facts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast import schemas
from arealcast.session import materialize
from arealcast.sources.published import now, publish, read_published

# Partition columns and the time column that names a chunk.
LAYOUT = {
    "fc": (["year", "month", "lead_time"], "init_time"),
    "an": (["year", "month"], "time"),
    "daily": (["year", "month"], "time"),
}


def with_chunk_columns(df: DataFrame, kind: str) -> DataFrame:
    """Forecast chunks go by init month and lead, the others by their own month."""
    time = LAYOUT[kind][1]
    return df.withColumn("year", F.year(time)).withColumn("month", F.month(time))


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Finished chunks: the partition columns, n_rows and stamp (NULL if the source has none)."""
    return read_published(spark, f"{path.rstrip('/')}/_ledger")


def write_chunks(df: DataFrame, path: str, kind: str, stamps: DataFrame | None = None) -> DataFrame:
    """Replace exactly the partitions present in ``df`` and enter them into the ledger; returns the ledger's new rows.

    ``stamps``: partition columns and stamp of the chunks that were asked for. Those of them that gave no row are entered
    with none, so that they are not asked for again. The rebalance hint gathers each partition's rows, splitting large
    partitions over several tasks.
    """
    spark, keys = df.sparkSession, LAYOUT[kind][0]
    rows = with_chunk_columns(schemas.conform(df, kind), kind)
    path = path.rstrip("/")
    mark = now(spark, path)
    (
        rows.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    # Rows of every chunk as the footers of its files tell, and when they were written; no column is read.
    changed = F.unix_millis(F.max("_metadata.file_modification_time")).alias("at")
    there = lambda: spark.read.schema(rows.schema).parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), changed)
    if stamps is None:
        fresh = there().where(F.col("at") >= mark).select(*keys, "n_rows", F.lit(None).cast("string").alias("stamp"))
    else:
        # What was asked for and not written has no rows any more.
        stamps = stamps.select(*keys, F.col("stamp").cast("string")).distinct()
        _remove(spark, path, keys, there().where(F.col("at") < mark).join(stamps, keys, "left_semi"))
        fresh = stamps.join(there(), keys, "left").select(*keys, F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "stamp")
    fresh = materialize(fresh.select(*[F.col(k).cast("int").alias(k) for k in keys], "n_rows", "stamp"), "fresh")
    before = read_ledger(spark, path, kind)
    ledger = fresh if before is None else fresh.unionByName(before.join(fresh, keys, "left_anti"))
    publish(ledger.coalesce(1), f"{path}/_ledger")
    return fresh


def _remove(spark: SparkSession, path: str, keys: Sequence[str], chunks: DataFrame) -> list[str]:
    """Delete the folders of the given chunks; one row per chunk reaches the driver."""
    gone = []
    for row in chunks.select(*keys).distinct().toLocalIterator():
        folder = path + "".join(f"/{k}={row[k]}" for k in keys)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(target):
            fs.delete(target, True)
            gone.append(folder)
    return sorted(gone)


def append_batches(spark: SparkSession, batches: Sequence[DataFrame], path: str, kind: str) -> bool:
    """Union of per-month results as one output; empty batches add nothing, no row means no output.

    The union is evaluated once: it is written as the next version, which is withdrawn if it has no row.
    """
    if not batches:
        return False
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch)
    return publish(schemas.conform(out, kind), path, unless_empty=True) is not None


def existing_chunks(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Partition columns of the finished chunks, from the ledger."""
    ledger = read_ledger(spark, path, kind)
    return None if ledger is None else ledger.select(*LAYOUT[kind][0])


def pending_chunks(wanted: DataFrame, path: str, kind: str) -> DataFrame:
    """Wanted chunks (partition columns and, if the source has one, stamp) that are not finished or have another stamp."""
    keys = LAYOUT[kind][0]
    stamp = F.col("stamp").cast("string") if "stamp" in wanted.columns else F.lit(None).cast("string")
    rows = wanted.select(*keys, stamp.alias("stamp")).distinct()
    done = read_ledger(wanted.sparkSession, path, kind)
    if done is None:
        return rows
    done = done.select(*keys, F.col("stamp").alias("_done"))
    same = [rows[k] == done[k] for k in keys]
    # A source without stamps takes every finished chunk as up to date.
    fresh = rows["stamp"].isNull() | rows["stamp"].eqNullSafe(done["_done"])
    return rows.join(done, [*same, fresh], "left_anti")


def catalogue_chunks(files: DataFrame, kind: str) -> DataFrame:
    """Chunks of a file catalogue with a stamp: number of files, bytes and latest change of those that make a chunk.

    ``files``: the partition columns, length and modificationTime, one row per file. Reads no file.
    """
    return files.groupBy(*LAYOUT[kind][0]).agg(
        F.concat_ws("/", F.count(F.lit(1)), F.sum("length"), F.unix_micros(F.max("modificationTime"))).alias("stamp")
    )


def resume(
    source: DataFrame,
    path: str,
    kind: str,
    build: Callable[[DataFrame], DataFrame] = lambda df: df,
    force: bool = False,
    catalogue: DataFrame | None = None,
) -> bool:
    """Build and write only the chunks of ``source`` that are not finished. Returns whether any was.

    ``catalogue``: the chunks there are, with their stamp (``catalogue_chunks``). With it the facts are read only for the
    chunks to build, and a chunk whose source files have changed is built again. Without it the chunks are listed from
    the source's own rows.
    """
    keys, _ = LAYOUT[kind]
    rows = with_chunk_columns(source, kind)
    wanted = rows.select(*keys).distinct() if catalogue is None else catalogue
    todo = wanted if force else pending_chunks(wanted, path, kind)
    if "stamp" not in todo.columns:
        todo = todo.withColumn("stamp", F.lit(None).cast("string"))
    # Written once, a row per chunk: listing the chunks may cost a pass over the source, and they are asked for again below.
    todo = materialize(todo.select(*keys, "stamp"), "todo")
    if todo.isEmpty():
        return False
    write_chunks(build(rows.join(todo.select(*keys), keys, "left_semi")), path, kind, todo)
    return True


def drop_partitions(spark: SparkSession, path: str, kind: str, flagged: DataFrame) -> list[str]:
    """Delete exactly the flagged chunk partitions (opt-in cleanup). Returns the deleted folders.

    They leave the ledger first, so an interrupted cleanup never leaves a finished chunk without files.
    """
    keys, path = LAYOUT[kind][0], path.rstrip("/")
    chosen = flagged.select(*keys).distinct()
    ledger = read_ledger(spark, path, kind)
    if ledger is not None:
        publish(ledger.join(chosen, keys, "left_anti").coalesce(1), f"{path}/_ledger")
    return _remove(spark, path, keys, chosen)
