"""How five text filters interact in every order, kept up to date by an incremental stream with retractions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealcast.session import shared_dir

LETTERS = "ABCDE"
#: Fewest words, share of distinct words and of capitals in percent, and the characters of filter D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
REPEATED = 1 << LETTERS.index("E")
WHITE = r"[\x20\x09-\x0D]"

COUNTERS = "part string, mask int, good boolean, toxic boolean, n long"
HOLDERS = "key binary, id long, part string, mask int, good boolean, toxic boolean, n long"


def place() -> Column:
    """Ids in order; a null id is larger than any other."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"))


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; it says nothing about other texts."""
    words = F.split(F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", ""), f"{WHITE}+")
    found = F.filter(words, lambda w: w != "")
    n, kinds = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        n < LEAST_WORDS,
        F.lit(100).cast("long") * kinds < F.lit(DISTINCT_PERCENT).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(CAPITALS_PERCENT).cast("long") * F.length(text),
        F.regexp_like(text, F.lit(f"[{SYMBOLS}]")),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """(key, id, part, mask): the text's digest instead of the text, and the filters it fails by itself."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("key"),
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        own_mask(text).alias("mask"),
    )


def marks(labels: DataFrame) -> DataFrame:
    """(id, good, toxic), one row per labelled id: marked if any of its label rows marks it."""
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    return rows.agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )


def _moved(rows: DataFrame, sign: int) -> DataFrame:
    """Counter changes of rows that become (sign 1) or stop being (-1) the first of their text."""
    first = F.struct(F.col("mask").alias("to"), F.lit(sign).alias("s"))
    other = F.struct(F.col("mask").bitwiseOR(REPEATED).alias("to"), F.lit(-sign).alias("s"))
    moved = rows.select("part", "good", "toxic", "n", F.explode(F.array(first, other)).alias("c"))
    return moved.select("part", F.col("c.to").alias("mask"), "good", "toxic", (F.col("n") * F.col("c.s")).alias("n"))


def fold(spark: SparkSession, batch: DataFrame, earlier: DataFrame, labels: DataFrame, home: str, number: int) -> None:
    """Take one micro-batch of features into the state and the counters.

    Every row first counts as a repetition of another text (filter E), which takes no knowledge of other rows. The rows of
    a text's smallest id are then moved out of E, and where an earlier batch had a larger smallest id, its rows are
    moved back. ``earlier``: state rows (HOLDERS) of the batches before this one; only rows of texts that this batch has
    are looked at. State and counters of a batch are its own folders, so a repeated batch changes nothing.
    """
    labelled = batch.join(labels, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    counted = labelled.groupBy("key", "id", "part").agg(
        F.max("mask").alias("mask"), F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")
    )
    counted.write.mode("overwrite").parquet(f"{home}/counted/batch={number}")
    counted = spark.read.schema(HOLDERS).parquet(f"{home}/counted/batch={number}")
    least = counted.groupBy("key").agg(F.min(place()).alias("least"))
    state = earlier.join(least.select("key"), "key", "left_semi")
    before = state.groupBy("key").agg(F.min(place()).alias("before"))
    # Texts whose first id this batch sets or shares, and the first id that they had.
    lowered = least.join(before, "key", "left").where(F.col("before").isNull() | (F.col("least") <= F.col("before")))
    lowered.write.mode("overwrite").parquet(f"{home}/lowered/batch={number}")
    lowered = spark.read.parquet(f"{home}/lowered/batch={number}")
    fresh = counted.join(lowered, "key").where(place() == F.col("least")).select(*counted.columns)
    fresh.write.mode("overwrite").parquet(f"{home}/state/batch={number}")
    fresh = spark.read.schema(HOLDERS).parquet(f"{home}/state/batch={number}")
    overtaken = earlier.join(lowered.where("before > least"), "key").where(place() == F.col("before"))
    repeated = counted.select("part", F.col("mask").bitwiseOR(REPEATED).alias("mask"), "good", "toxic", "n")
    changes = repeated.union(_moved(fresh, 1)).union(_moved(overtaken, -1))
    sums = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    sums.write.mode("overwrite").parquet(f"{home}/counters/batch={number}")


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """(part, mask, good, toxic, n) over all documents below ``path``, by an available-now stream over its files.

    ``batches``: micro-batches that the files are dealt over, so the state is read so many times whatever the size.
    """
    table = spark.read.parquet(path)
    home = shared_dir(spark, "filter-audit")
    known = marks(labels)
    known.write.parquet(f"{home}/labels")
    known = spark.read.schema(known.schema).parquet(f"{home}/labels")
    # So that a table without a batch has counters and a state too.
    for name, schema in (("counters", COUNTERS), ("state", HOLDERS)):
        spark.createDataFrame([], schema).write.parquet(f"{home}/{name}/batch=-1")

    def take(batch: DataFrame, number: int) -> None:
        # The stream's own session plans without run-time statistics; it only turns texts into features.
        features(batch).write.mode("overwrite").parquet(f"{home}/features/batch={number}")
        rows = spark.read.parquet(f"{home}/features/batch={number}")
        earlier = spark.read.schema(f"{HOLDERS}, batch int").parquet(f"{home}/state").where(F.col("batch") < number).drop("batch")
        fold(spark, rows, earlier, known, home, number)

    path = path.rstrip("/")
    (
        spark.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", math.ceil(max(1, len(table.inputFiles())) / batches))
        # As a pattern, which the source takes for a folder and for a single file alike.
        .parquet(f"{path[:-1]}[{path[-1]}]")
        .select("doc_id", "text", "lang")
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    counters = spark.read.schema(f"{COUNTERS}, batch int").parquet(f"{home}/counters")
    return counters.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


def interactions(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters alone."""
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_mask = counters.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    # At most 32 entries a part.
    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(LETTERS)])
    steps = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    rows = parts.select("part", "m", F.explode(orders).alias("filter_order"))
    rows = rows.select("part", "m", "filter_order", F.explode(steps).alias("step"))
    index = lambda i: F.instr(F.lit(LETTERS), F.substring("filter_order", i, F.lit(1))) - 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1), index(i))
    earlier = F.aggregate(steps, F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(i)).otherwise(0))
    rows = rows.withColumns({"own": bit(F.col("step")), "earlier": earlier})
    own, earlier = F.col("own"), F.col("earlier")

    def total(what, where) -> Column:
        return F.aggregate(F.filter("m", where), F.lit(0).cast("long"), lambda a, x: a + what(x))

    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    here = lambda x: has(x, own) & ~has(x, earlier)
    orders_first = math.factorial(len(LETTERS))  # a filter is the first of k failing ones in one of k orders
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: x["n"], lambda x: ~has(x, own.bitwiseOR(earlier))).alias("kept"),
        total(lambda x: x["n"], here).alias("removed"),
        total(lambda x: x["n"], lambda x: has(x, own) & has(x, earlier)).alias("redundant"),
        total(lambda x: x["n"], lambda x: x["mask"] == own).alias("unique_fails"),
        total(lambda x: x["good"], here).alias("good_lost"),
        total(lambda x: x["toxic"], here).alias("toxic_lost"),
        total(
            lambda x: x["n"] * (F.lit(orders_first) / F.bit_count(x["mask"])).cast("long"), lambda x: has(x, own)
        ).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """Per part, order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``path``: a Parquet table with doc_id, text and lang. Null texts are empty texts, a null lang is part ''. A null id is
    larger than any other, so its text repeats the same text of any other id. Rows that repeat, or that share an id,
    count each; none of one id repeats another of that id. A labelled id is good or toxic if any of its label rows says
    so; labels of null or unknown ids count nothing. An empty table gives no rows.
    """
    return interactions(stream_counters(spark, path, labels, batches))
