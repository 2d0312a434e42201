"""Divergence of the sources of each language, from exact counts of the terms that are frequent enough.

The first pass finds the terms of each language that enough of its documents hold. Minimal perfect hashes over them, built
shard by shard, give every term a slot. The second pass reads the texts again and increments one dense row of slots per
group (language, source); strings that are no kept term are told apart by the stored keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealcast.llm.common import materialize_lean
from arealcast.llm.perfect_hash import PerfectHash, build

LEAST_DOCS, RANKS, SCALE = 3, 200, 10**9
SHARD_TERMS = 1 << 14  # terms of a shard on average
#: Bytes of stored keys that are sent to every task; more terms are met by shuffling counts to their shards.
BROADCAST_BYTES = 64 << 20
HELD = 1 << 19  # distinct terms that a task holds before it passes counts on
SLOTS = 1 << 25  # dense slots that a task holds before it passes counts on
PORTION = 4 << 20  # bytes of text that are counted at once
CELLS = 1 << 20  # sources times slots of one block

_BREAKS = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

COUNT_ROWS = "lang string, source string, slot bigint, n bigint"
TERM_ROWS = "lang string, source string, term binary, n bigint"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z lower-cased. Bytes from 0x80 on are those of non-ASCII characters."""
    return text.translate(_BREAKS).split()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(len(texts))):
            yield lang, source, texts[i].as_py()


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (lang, source, text): (lang, term, n), documents that hold the term, summed over a part of the task's rows."""
    held: dict[str, Counter] = {}
    for lang, _, text in _rows(batches):
        held.setdefault(lang, Counter()).update(set(terms_of(text)))
        if sum(map(len, held.values())) >= HELD:
            yield from _term_batches({(k,): c for k, c in held.items()}, ["lang"])
            held = {}
    yield from _term_batches({(k,): c for k, c in held.items()}, ["lang"])


def _term_batches(held: dict[tuple, Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    for key, counts in held.items():
        if counts:
            keys = [pa.array([k] * len(counts), pa.string()) for k in key]
            columns = [*keys, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "term", "n"])


def group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], Counter]]:
    """Counts of terms by group, over portions of the task's rows."""
    held: dict[tuple[str, str], Counter] = {}
    size = 0
    for lang, source, text in _rows(batches):
        held.setdefault((lang, source), Counter()).update(terms_of(text))
        size += len(text)
        if size >= PORTION:
            yield held
            held, size = {}, 0
    if held:
        yield held


def kept_terms(rows: DataFrame) -> DataFrame:
    """(lang, term) of the terms that at least ``LEAST_DOCS`` documents of the language hold."""
    counted = rows.mapInArrow(document_counts, "lang string, term binary, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).drop("n")


def build_shard(rows: pa.Table) -> pa.Table:
    keys = rows["term"].to_pylist()
    sizes, bits, keys = build(keys)
    columns = {
        "lang": rows["lang"][:1],
        "shard": rows["shard"][:1],
        "shards": rows["shards"][:1],
        "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "bits": pa.array([bits], pa.binary()),
        "keys": pa.array([keys], pa.list_(pa.binary())),
    }
    return pa.table(columns)


SHARD_ROWS = "lang string, shard bigint, shards bigint, sizes array<bigint>, bits binary, keys array<binary>"


def perfect_shards(kept: DataFrame) -> DataFrame:
    """One row per shard, with ``base``, the first of its slots in the language."""
    shards = F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("long")
    sized = kept.join(kept.groupBy("lang").agg(shards.alias("shards")), "lang")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    built = materialize_lean(dealt.groupBy("lang", "shard").applyInArrow(build_shard, SHARD_ROWS), "perfect-hashes")
    # One row per shard: a few thousandths of the terms.
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = built.select("lang", "shard", F.coalesce(F.sum(F.size("keys")).over(before), F.lit(0)).alias("base"))
    return built.join(bases, ["lang", "shard"])


def _flush(dense: dict[tuple[str, str], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, source), slots in dense.items():
        at = np.flatnonzero(slots)
        if len(at):
            columns = [pa.array([x] * len(at), pa.string()) for x in (lang, source)]
            columns += [pa.array(at, pa.int64()), pa.array(slots[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "slot", "n"])


def recount_here(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Counts by slot with all perfect hashes at every task; for at most ``BROADCAST_BYTES`` of keys."""
    by_lang: dict[str, list] = {}
    for r in shards.select("lang", "shard", "shards", "sizes", "bits", "keys").orderBy("lang", "shard").collect():
        own = by_lang.setdefault(r.lang, [([], b"", [])] * r.shards)
        own[r.shard] = (r.sizes, bytes(r.bits), [bytes(k) for k in r.keys])
    sent = rows.sparkSession.sparkContext.broadcast({lang: PerfectHash.of(s) for lang, s in by_lang.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        dense: dict[tuple[str, str], np.ndarray] = {}
        used = 0
        for portion in group_counts(batches):
            for group, counts in portion.items():
                known = hashes.get(group[0])
                if known is None or not counts:
                    continue
                if group not in dense:
                    if used and used + len(known.keys) > SLOTS:
                        yield from _flush(dense)
                        dense, used = {}, 0
                    dense[group] = np.zeros(len(known.keys), np.int64)
                    used += len(known.keys)
                slots = known.slots(list(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                dense[group][slots[slots >= 0]] += n[slots >= 0]  # terms are distinct, so are their slots
        yield from _flush(dense)

    return rows.mapInArrow(count, COUNT_ROWS)


def recount_in_shards(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """The same counts with every shard in one task of its own, to which the counts of its strings are sent."""

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in group_counts(batches):
            yield from _term_batches(portion, ["lang", "source"])

    def meet(counts: pa.Table, shard: pa.Table) -> pa.Table:
        if not shard.num_rows or not counts.num_rows:
            return counts.select(["lang", "source", "n", "n"]).rename_columns(["lang", "source", "slot", "n"]).slice(0, 0)
        r = shard.to_pylist()[0]
        slots = PerfectHash.of([(r["sizes"], r["bits"], r["keys"])]).slots(counts["term"].to_pylist())
        known = pa.array(slots >= 0)
        slot = pa.chunked_array([pa.array(slots + r["base"])])
        return pa.table({"lang": counts["lang"], "source": counts["source"], "slot": slot, "n": counts["n"]}).filter(known)

    counted = rows.mapInArrow(pass_on, TERM_ROWS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    number = shards.groupBy("lang").agg(F.max("shards").alias("shards"))
    dealt = counted.join(number, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    narrow = shards.select("lang", "shard", "base", "sizes", "bits", "keys")
    return dealt.groupBy("lang", "shard").cogroup(narrow.groupBy("lang", "shard")).applyInArrow(meet, COUNT_ROWS)


def shares(count: np.ndarray, total) -> np.ndarray:
    """p of every count; ``total``: N + V of the group, a number or a column."""
    if len(count) and count.max() >= (1 << 62) // SCALE:
        return (SCALE * (count.astype(object) + 1) // total + 1).astype(np.int64)
    return SCALE * (count + 1) // total + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def compare_block(rows: pa.Table) -> pa.Table:
    """For all rows of one block of slots of a language: sums of the pairs of its sources, and the block's first terms.

    A row has a term (the key of its slot), or a source: its count in a slot or, without a slot, its N and V.
    """
    lang = rows["lang"][0].as_py()
    term, source, slot, n, v = (rows[c].to_pylist() if c in ("term", "source") else rows[c].to_numpy() for c in ("term", "source", "slot", "n", "v"))
    groups = sorted((s, int(n[i]), int(v[i])) for i, s in enumerate(source) if s is not None and term[i] is None and v[i] >= 0)
    index = {g[0]: i for i, g in enumerate(groups)}
    keys = sorted((int(slot[i]), t) for i, t in enumerate(term) if t is not None)
    first = keys[0][0]
    counts = np.zeros((len(groups), len(keys)), np.int64)
    for i, s in enumerate(source):
        if s is not None and v[i] < 0:
            counts[index[s], int(slot[i]) - first] = n[i]
    total = np.array([g[1] + g[2] for g in groups], np.int64)
    p = shares(counts, total[:, None])
    out: list[tuple] = []
    for a, (name, _, _) in enumerate(groups):
        sums = distance(p[a], p).sum(axis=1)
        out += [(name, "pair", g[0].encode(), int(x)) for g, x in zip(groups, sums) if g[0] != name]
    q = shares(counts.sum(axis=0), sum(g[1] for g in groups) + groups[0][2])
    place = np.empty(len(keys), np.int64)
    place[sorted(range(len(keys)), key=lambda i: keys[i][1])] = np.arange(len(keys))
    for a, (name, _, _) in enumerate(groups):
        at = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        f = distance(p[a, at], q[at])
        best = np.lexsort((place[at], -f))[:RANKS]
        out += [(name, "term", keys[at[i]][1], int(f[i])) for i in best.tolist()]
    source, part, item, value = zip(*out) if out else ((), (), (), ())
    columns = [pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string())]
    columns += [pa.array(item, pa.binary()).cast(pa.string()), pa.array(value, pa.int64())]
    return pa.table(columns, ["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per group (lang, source): its distance to every other source of the language, and the terms it has too often.

    Columns lang, source, part (``pair`` or ``term``), item, value, rank. Null text, lang and source are ''. A document is a
    row; rows that repeat count each. A language without kept terms gives pairs of value 0 and no terms; an empty table
    gives no rows. All counts are exact and cover all rows.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")])
    kept = materialize_lean(kept_terms(rows), "kept-terms")
    shards = materialize_lean(perfect_shards(kept), "shards")
    size = shards.agg(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + F.length(k) + 8))).first()[0] or 0
    counted = recount_here(rows, shards) if size <= broadcast_bytes else recount_in_shards(rows, shards)
    counts = counted.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))
    counts = materialize_lean(counts, "slot-counts")

    # One row per group: small next to the texts, and the result itself has more.
    groups = rows.select("lang", "source").distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = materialize_lean(groups.select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v")), "groups")

    # Blocks of slots, so small that a block's table of all sources fits a task.
    width = F.greatest(F.lit(1).cast("long"), F.least(F.lit(1 << 15).cast("long"), F.expr(f"{CELLS} div count(1)")))
    widths = groups.where("v > 0").groupBy("lang").agg(width.alias("width"), F.max("v").alias("all"))
    none = F.lit(None)
    keyed = shards.select("lang", "base", F.posexplode("keys").alias("i", "term")).select(
        "lang", none.cast("string").alias("source"), (F.col("base") + F.col("i")).alias("slot"), "term", zero.alias("n"), F.lit(-1).cast("long").alias("v")
    )
    counted = counts.select("lang", "source", "slot", none.cast("binary").alias("term"), "n", F.lit(-1).cast("long").alias("v"))
    placed = keyed.unionByName(counted).join(widths, "lang").select("*", F.expr("slot div width").alias("block")).drop("width", "all")
    every = groups.join(widths, "lang").select(
        "lang", "source", F.lit(-1).cast("long").alias("slot"), none.cast("binary").alias("term"), "n", "v",
        F.explode(F.sequence(zero, F.expr("(all - 1) div width"))).alias("block"),
    )
    blocks = placed.unionByName(every).groupBy("lang", "block")
    found = blocks.applyInArrow(compare_block, "lang string, source string, part string, item string, value bigint")
    found = materialize_lean(found, "blocks")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source != item").join(pairs, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    return pairs.select("*", rank).union(terms.select("*", rank).where(F.col("rank") <= RANKS))
