"""Benchmark items inside documents: size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.llm.common import alnum_words, unused_name
from arealcast.session import materialize

WIDTH, CONTAINMENT = 5, 0.8


def shingle_hashes(words: Column, width: Column | int) -> Column:
    """ARRAY<BIGINT>: distinct hashes of the runs of ``width`` words; none where there are fewer words."""
    w = F.lit(width) if isinstance(width, int) else width
    if isinstance(width, int):
        hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    else:
        hashed = lambda i: F.xxhash64(F.slice(words, i + 1, w))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - w), hashed)
    return F.when(F.size(words) >= w, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, width: Column) -> Column:
    """ARRAY<STRING>: the distinct shingles themselves, for the exact comparison."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(F.size(words) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, width, shingles, size, part, need, sketch): one row per item that has words.

    Items are partitioned by the power of two of their number of shingles. An item's sketch is its ``m`` least shingle
    hashes, m = floor((1 - containment) * largest size of its partition) + 1, at most all. A document that holds
    ``need`` of the shingles lacks fewer than m of them, so it holds one of the sketch: no match is missed.
    Items of fewer than ``width`` words are one shingle of all their words.
    """
    words = alnum_words(F.col("text"))
    rows = items.select("item_id", words.alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.lit(width), F.size("words")))
    # Hashes in the same way as documents hash theirs: one argument per word.
    by_width = F.coalesce(
        *[F.when(F.col("width") == w, shingle_hashes(F.col("words"), w)) for w in range(1, width + 1)]
    )
    rows = rows.select("item_id", "width", by_width.alias("hashes"), shingle_texts(F.col("words"), F.col("width")).alias("shingles"))
    rows = rows.withColumn("size", F.size("shingles"))
    part = F.floor(F.log2("size")).cast("int")
    most = F.floor((1 - containment) * (F.pow(F.lit(2), part + 1) - 1) + 1e-9).cast("int") + 1
    return rows.select(
        "item_id",
        "width",
        "shingles",
        "size",
        part.alias("part"),
        F.ceil(containment * F.col("size") - 1e-9).cast("int").alias("need"),
        F.slice(F.array_sort("hashes"), F.lit(1), most).alias("sketch"),
    )


def candidates(docs: DataFrame, sketches: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, item_id): documents that hold a shingle of the item's sketch and are large enough to hold the item.

    Every document's shingles go through, each once. The sketches are a written table; Spark sends them to the documents
    where they are small and shuffles both sides by hash where they are not.
    """
    index = sketches.select("item_id", "width", "need", F.explode("sketch").alias("hash"))
    words = docs.select("doc_id", alnum_words(F.col("text")).alias("words"))
    sized = F.array(
        *[F.struct(F.lit(w).alias("width"), shingle_hashes(F.col("words"), w).alias("hashes")) for w in widths]
    )
    each = words.select("doc_id", F.explode(sized).alias("s")).select("doc_id", "s.width", "s.hashes")
    each = each.select("doc_id", "width", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    return each.join(index, ["hash", "width"]).where("n >= need").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) with at least ``containment`` of the item's shingles
    of ``width`` words in the document.

    Words are alphanumeric and A-Z lower-cased, so that case, punctuation and spacing do not hide an item. Items without
    a word match nothing; null texts have no words. Rows that share a doc_id are one document each, and the best of them
    counts; the same holds for items. Null ids are ids.
    """
    found = materialize(item_sketches(items.select("item_id", "text"), width, containment), "sketches")
    widths = sorted(r.width for r in found.select("width").distinct().collect())  # at most ``width`` values
    if not widths:
        return docs.select("doc_id").crossJoin(items.select("item_id")).limit(0).selectExpr("doc_id", "item_id", "0 n_shared", "0 n_shingles", "0D containment")
    narrow = docs.select("doc_id", "text")
    pairs = materialize(candidates(narrow, found, widths), "candidates")
    items_ = found.select("item_id", "width", "shingles", "size", "need")
    wanted = pairs.withColumnRenamed("doc_id", "wanted")
    exact = (
        narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")))
        .drop("wanted")
        .join(items_.withColumnRenamed("item_id", "known"), F.col("item_id").eqNullSafe(F.col("known")))
        .drop("known")
    )
    # The words are a column of their own: as an expression they would be split anew for every shingle.
    exact = exact.withColumn("words", alnum_words(F.col("text"))).drop("text")
    held = shingle_texts(F.col("words"), F.col("width"))
    n_shared = F.size(F.array_intersect("shingles", held))
    exact = exact.select("doc_id", "item_id", "size", "need", n_shared.alias("n_shared"))
    best = exact.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("n_shared") / F.col("size"), "n_shared", "size", "need")).alias("b")
    )
    # Filtered behind the aggregation: before it, Spark would move the test to where the words are not yet split.
    best = best.where("b.n_shared >= b.need")
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n_shared").alias("n_shared"),
        F.col("b.size").alias("n_shingles"),
        (F.col("b.n_shared") / F.col("b.size")).alias("containment"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no pair, with all columns."""
    gone = materialize(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    name = unused_name(docs, "gone")
    gone = gone.withColumnRenamed("doc_id", name)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]), "left_anti")
