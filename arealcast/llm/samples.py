"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealcast.session import materialize


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Longest text in bytes that a classifier learns from; with the number of rows it bounds what the driver gets.
TEXT_BYTES = 1 << 16


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, each: int = 0, kinds: int = 0
) -> list[tuple[bytes, object]]:
    """At most ``most`` pairs (text, label), the first by a hash of the id; the same rows in every run.

    With ``each``, the first rows of every label come besides, at most ``each`` of ``kinds`` labels. ``labels``: (doc_id,
    label). An id counts once: of several labels the least, of several texts the one of the least hash. Null and empty
    texts, and those of over ``TEXT_BYTES``, teach nothing and use up no row. Only the chosen ids meet the texts.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0) & (F.octet_length("text") <= TEXT_BYTES))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    ids = texts.select("doc_id").distinct().join(known, "doc_id").withColumn("at", F.xxhash64("doc_id", F.lit(3)))
    chosen = ids.orderBy("at", "doc_id").limit(most)
    if each:
        rank = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))
        firsts = ids.withColumn("rank", rank).where(F.col("rank") <= each).orderBy("rank", "at", "doc_id").limit(each * kinds)
        chosen = chosen.union(firsts.drop("rank")).distinct()
    chosen = materialize(chosen.drop("at"), "sample")
    rows = texts.select("doc_id", "text").join(chosen, "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.select("doc_id", F.encode("text", "utf-8").alias("text"), "label").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.text)))
    return [(bytes(r.text), r.label) for r in found]
