"""Incremental jobs on Structured Streaming file sources.

Each job takes what has arrived since its last run (``availableNow``) and stops. Both sinks are idempotent
per micro-batch, so a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arealcast.operators.climatology import drop_leap_days, merge_climatology, merge_partials, partial_climatology
from arealcast.sources.chunks import LAYOUT, with_chunk_columns, write_chunks
from arealcast.sources.published import current, publish, read_published


def new_chunks(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    kind: str,
    build: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Bring every chunk touched by newly arrived files up to date.

    A chunk may gain files over several runs, so each touched chunk is rebuilt from all of its source rows
    and replaced as a whole.
    """
    keys, time = LAYOUT[kind]

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        touched = with_chunk_columns(batch, kind).select(*keys).distinct()
        months = sorted((r.year, r.month) for r in touched.select("year", "month").distinct().collect() if r.year is not None)
        if not months:
            return
        # Literal limits of the touched months reach the Parquet statistics, so files of other months are skipped.
        t = F.col(time)
        within = reduce(
            Column.__or__,
            [(t >= F.lit(lo).cast("timestamp_ntz")) & (t < F.lit(hi).cast("timestamp_ntz")) for lo, hi in month_spans(months)],
        )
        everything = with_chunk_columns(spark.read.schema(schema).parquet(source).where(within), kind)
        rows = everything.join(touched, keys, "left_semi")
        write_chunks(build(rows), target, kind, touched.withColumn("stamp", F.lit(None).cast("string")))

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(rebuild)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def month_spans(months: Sequence[tuple[int, int]]) -> list[tuple[str, str]]:
    """First day of each run of neighbouring months, and the first day after it."""
    number = [12 * y + m - 1 for y, m in months]
    first = lambda n: f"{n // 12:04d}-{n % 12 + 1:02d}-01"
    out: list[list[int]] = []
    for n in sorted(set(number)):
        if out and out[-1][1] == n:
            out[-1][1] = n + 1
        else:
            out.append([n, n + 1])
    return [(first(a), first(b)) for a, b in out]


def climatology_state(
    stream: DataFrame, state: str, checkpoint: str, var: str = "t2m"
) -> StreamingQuery:
    """Fold arriving daily rows (geo_id, time, var) into stored sums and counts.

    The state is one published table of a row per area and day: every micro-batch merges into it and publishes the next
    version, so it never grows with the number of batches. Its manifest tells the last batch of every checkpoint
    that is in it, so a batch that is repeated after a failure is passed over, and a new checkpoint over an existing state
    adds to it. Checkpoints are told apart by the query id they hold.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        before = current(spark, state)
        done = {} if before is None else before.note
        if done.get(run, -1) >= batch_id:
            return
        part = partial_climatology(drop_leap_days(batch), var)
        if before is not None:
            part = merge_partials(part.unionByName(read_published(spark, state).select(*part.columns)))
        publish(part, state, note={**done, run: batch_id})

    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def climatology_from_state(spark: SparkSession, state: str, var: str = "t2m") -> DataFrame:
    return merge_climatology(read_published(spark, state), var)
