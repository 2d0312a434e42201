"""Near-duplicates by SimHash fingerprints, with pivot distance tables in front of the comparison."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.llm.common import SPACE_WORD, bound_batches, materialize_lean, sent_if_small, unused_name
from arealcast.llm.components import min_label, roots
from arealcast.session import materialize

SEED = 42
SLAB = 1 << 15  # shingles whose bits are in memory at once
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(h: np.ndarray, k: np.uint64) -> np.ndarray:
    """Another 64 bits from a 64-bit hash."""
    h = (h ^ (h >> np.uint64(32))) * k
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words in order, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, words64: int) -> bytes:
    """Big-endian fingerprint; a bit is set if it is set in over half of the hashes, of which further bits are mixed."""
    n = len(hashes)
    ones = np.zeros(64 * words64, np.int64)
    for low in range(0, n, SLAB):
        h = hashes[low : low + SLAB]
        raw = np.stack([h, *[_mixed(h, k) for k in _SPREAD[: words64 - 1]]], axis=1).astype(">u8").tobytes()
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(h), 64 * words64)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint_of(text: bytes, width: int, words64: int) -> bytes:
    """Fingerprint of all shingles of ``text``, repeats included; zero for a text without a word."""
    return majority(shingle_hashes(text, width), words64)


def fingerprint(text: Column, width: int = 3, words64: int = 1) -> Column:
    """BINARY fingerprint of ``64 * words64`` bits over shingles of ``width`` words. Null and empty texts: all zero."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x or b"", width, words64) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return of(text)


@dataclass(frozen=True)
class Links:
    """Which fingerprints are linked, and the bit groups whose equality brings two of them together.

    ``keys``: tuples of bit positions. Two fingerprints are compared if all bits of one tuple are equal.
    """

    bits: int
    distance: int
    keys: tuple[tuple[int, ...], ...]


def exact_links(n: int, bits: int = 64, distance: int = 3) -> Links:
    """Keys under which no pair within ``distance`` is missed, short enough for buckets of a few dozen of ``n``.

    With ``distance + e`` blocks at least ``e`` agree in any such pair, so every choice of ``e`` blocks is a key.
    """
    e = 1
    while (n >> (bits * e // (distance + e))) > 64 and e < 4:
        e += 1
    edges = [bits * i // (distance + e) for i in range(distance + e + 1)]
    blocks = [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]
    return Links(bits, distance, tuple(sum(c, ()) for c in itertools.combinations(blocks, e)))


PIVOTS = 16


def pivots(bits: int, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same in every run."""
    return np.random.default_rng(11).integers(0, 1 << 64, (n, bits // 64), np.uint64)


def as_words(fps: Sequence[bytes], bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), bits // 64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(words: np.ndarray, bits: int) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference; the difference of two rows never exceeds their distance."""
    return np.stack([distances(words, r) for r in pivots(bits)], axis=1)


def bucket_keys(fp: Column, links: Links) -> Column:
    """ARRAY<BIGINT>: one bucket per bit group, the group's number in the upper bits."""

    @F.arrow_udf("array<bigint>")
    def of(fps: pa.Array) -> pa.Array:
        raw = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), links.bits // 8)
        bits = np.unpackbits(raw, axis=1)
        out = np.empty((len(fps), len(links.keys)), np.int64)
        for g, group in enumerate(links.keys):
            weights = np.int64(1) << np.arange(len(group), dtype=np.int64)
            out[:, g] = (bits[:, list(group)].astype(np.int64) @ weights) | (g << 48)
        flat = pa.array(out.ravel(), pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * len(links.keys), pa.int32()), flat)

    return of(fp)


def _forest(words: np.ndarray, table: np.ndarray, distance: int) -> np.ndarray:
    """Edges (child, root) that join what is linked inside one bucket."""
    n = len(words)
    parent = np.arange(n)
    for low in range(0, n - 1, 256):
        rows = np.arange(low, min(n, low + 256))
        near = np.arange(n)[None, :] > rows[:, None]
        for p in range(PIVOTS):  # discard by the largest difference of pivot distances
            near &= np.abs(table[rows, p][:, None] - table[None, :, p]) <= distance
        i, j = np.nonzero(near)
        i = rows[i]
        good = distances(words[i], words[j]) <= distance
        parent = min_label(parent, i[good], j[good])
    child = np.flatnonzero(parent != np.arange(n))
    return np.stack([child, parent[child]], axis=1)


def _small(key: np.ndarray, words: np.ndarray, table: np.ndarray, distance: int) -> np.ndarray:
    """All linked pairs of buckets of a few members, compared by their distance in the sorted rows."""
    found, step, n = [], 1, len(key)
    at = np.arange(n)
    while True:
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            return np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        near = at[np.abs(table[at] - table[at + step]).max(axis=1) <= distance]
        near = near[distances(words[near], words[near + step]) <= distance]
        found.append(np.stack([near, near + step], axis=1))
        step += 1


def by_bucket(edges):
    """For rows sorted by ``bucket``, in batches: what ``edges`` makes of tables that hold whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["bucket"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if last or (held and held[0]["bucket"][-1].as_py() != key[0]):
                yield from edges(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from edges(pa.Table.from_batches(held))

    return run


def edge_batch(fps: Sequence[bytes], pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in pairs[:, k]], pa.binary()) for k in (0, 1)], ["a", "b"])


def links_in_buckets(links: Links, few: int = 256):
    """For rows (bucket, fp) sorted by bucket: edges between fingerprints, only a forest in buckets of over ``few``.

    What follows the fingerprint's ``links.bits`` in ``fp`` tells nodes of equal fingerprints apart.
    """

    def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, fps = rows["bucket"].to_numpy(), rows["fp"].to_pylist()
        cuts = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        size = end - begin
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            return
        words = as_words([x[: links.bits // 8] for x in fps], links.bits)
        table = pivot_table(words, links.bits)
        at = np.flatnonzero(np.repeat((size > 1) & (size <= few), size))
        found = [at[_small(key[at], words[at], table[at], links.distance)]]
        for a, b in zip(begin[size > few], end[size > few]):
            found.append(a + _forest(words[a:b], table[a:b], links.distance))
        pairs = np.concatenate(found)
        if len(pairs):
            yield edge_batch(fps, pairs)

    return by_bucket(edges)


def met(rows: DataFrame, *columns: str, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """``rows`` (fp, bucket, parts, columns) in buckets where every two parts of the old one meet, dealt by bucket and sorted
    by ``order``, which begins with it."""
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.xxhash64("bucket", F.least(o, own), F.greatest(o, own)),
    )
    whole = F.col("parts") == 1
    apart = rows.where(~whole).select("fp", *columns, F.explode(meets).alias("bucket"))
    dealt = rows.where(whole).select("fp", *columns, "bucket").union(apart)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "bucket").sortWithinPartitions(*order)


def linked(fps: DataFrame, links: Links, most: int = 512) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what ``links`` links."""
    return linked_in(fps.select("fp", F.explode(bucket_keys(F.col("fp"), links)).alias("bucket")), links, most)


def linked_in(rows: DataFrame, links: Links, most: int = 512, few: int = 256, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Edges (a, b) that connect the ``fp`` of ``rows`` (fp, bucket) within ``links.distance`` that share a bucket.

    A bucket of over ``most`` members is cut by hash into parts of about that size, and every two parts meet in a bucket
    of their own. So no task holds more than about twice ``most`` rows of a bucket, all pairs are compared, and of each
    bucket of over ``few`` only a forest comes out. Its roots are first in ``order``: with the fingerprints in it, the same
    few are roots in most buckets of a group, and edges that repeat go.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    # Written first, so that its true size, mostly next to nothing, decides how it is joined.
    rows = rows.join(materialize(sizes, "buckets"), "bucket", "left")
    rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("n") / most).cast("int"), F.lit(1)))
    return met(rows, order=order).mapInArrow(links_in_buckets(links, few), "a binary, b binary").distinct()


def cluster(rows: DataFrame, edges_of, id_col: str = "doc_id", *known: str) -> DataFrame:
    """``rows`` (id, fp) with component_id: the smallest id reachable over links, itself included.

    ``edges_of`` gives the links (a, b) of the nodes (fp, least id, columns ``known`` that follow from fp).

    Equal fingerprints are one node, so a group of copies of any size is one row from here on. Null ids are linked like
    others but never smallest; a component of null ids alone has component_id null.
    """
    columns = [F.any_value(c).alias(c) for c in known]
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least"), *columns), "fingerprints")
    moved = roots(edges_of(nodes))  # fingerprints that are linked to any other: (node, root)
    least = (
        moved.join(nodes.withColumnRenamed("fp", "node"), "node")
        .groupBy("root")
        .agg(F.min("least").alias("component_id"))
        .join(moved, "root")
        .select(F.col("node").alias("fp"), "component_id")
    )
    classes = nodes.select("fp", "least").join(materialize(least, "classes"), "fp", "left")
    classes = classes.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(classes, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Shingles of three words, 64 bits, links at three or fewer differing bits; complete, however large a group is. Texts
    without a word have fingerprint zero and are linked like any other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"))
    rows = materialize(rows, "documents")
    found = cluster(rows, lambda nodes: linked(nodes.select("fp"), exact_links(nodes.count())))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: The stage's documents are sets of five-word shingles. Candidates share the least hashes of one of BANDS groups of ROWS
#: hash functions and lie within 72 of 256 bits; at a Jaccard similarity of 0.8, 39 bits differ on average (standard
#: deviation 6; sets of five shingles 48), at 0.5 69. All pairs of a component of candidates are then compared exactly.
STAGE_BITS, STAGE_WIDTH, STAGE_DISTANCE = 256, 5, 72
BANDS, ROWS = 30, 6  # 0.8 ** 6 = 0.26: one pair in 9000 at 0.8 shares no band, whatever the number of documents
_DRAWN = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One bucket per band: a hash of the band and of the least values of its hash functions over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 2048):
        values = (x[None, low : low + 2048] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint32(1))
        np.minimum(least, values.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ (column.astype(np.uint64) + (key << np.uint64(32))), _SPREAD[0])
    return key.view(np.int64)


def shingle_set(text: bytes) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, STAGE_WIDTH))


_NODE = T.StructType().add("fp", T.BinaryType()).add("keys", T.ArrayType(T.LongType())).add("shingles", T.LongType())


@F.arrow_udf(_NODE)
def node_of(texts: pa.Array) -> pa.Array:
    """A set's fingerprint with 64 bits more that identify it, its buckets and its size."""
    fps, keys, sizes = [], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        x = shingle_set(text or b"")
        fps.append(majority(x, STAGE_BITS // 64) + xxhash.xxh64_digest(x.tobytes(), SEED))
        keys.append(band_keys(x))
        sizes.append(len(x))
    flat = pa.array(np.concatenate(keys) if keys else [], pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
    return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), lists, pa.array(sizes, pa.int64())], ["fp", "keys", "shingles"])


@F.arrow_udf(T.BinaryType())
def set_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x or b"").tobytes() for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def similar(sets: Sequence[np.ndarray]) -> np.ndarray:
    """A forest (child, root) of the pairs whose Jaccard similarity is 0.8 or more; every pair not yet joined is compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), np.uint8)
    parent = np.arange(len(sets))
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        # The size of the smaller set is the largest that both can share.
        j = j[(parent[j] != parent[i]) & (5 * np.minimum(size[j], size[i]) >= 4 * np.maximum(size[j], size[i]))]
        if not len(j):
            continue
        own = code[start[i] : start[i] + size[i]]
        held[own] = 1
        first = np.cumsum(size[j]) - size[j]
        at = np.repeat(start[j] - first, size[j]) + np.arange(first[-1] + size[j[-1]])
        shared = np.add.reduceat(held[code[at]], first, dtype=np.int64)
        held[own] = 0
        good = j[9 * shared >= 4 * (size[i] + size[j])]  # shared >= 0.8 of the union
        parent = min_label(parent, np.full(len(good), i), good)
    child = np.flatnonzero(parent != np.arange(len(sets)))
    return np.stack([child, parent[child]], axis=1)


def similar_in_buckets(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """For rows (bucket, fp, set) sorted by bucket: a forest of each bucket's similar pairs."""
    key, fps, sets = rows["bucket"].to_numpy(), rows["fp"].to_pylist(), rows["set"].to_pylist()
    cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(key)]):
        if b - a > 1:
            found.append(a + similar([np.frombuffer(x, np.uint64) for x in sets[a:b]]))
    pairs = np.concatenate(found) if found else ()
    if len(pairs):
        yield edge_batch(fps, pairs)


def verified(nodes: DataFrame, texts: DataFrame, repeats: bool, most: int = 256, weight: int = 1 << 19) -> DataFrame:
    """Edges (a, b) that connect the ``nodes`` (fp, least, keys, shingles) of Jaccard similarity 0.8 or more.

    Links by bands and fingerprints only say which sets may be similar, directly or over others: inside such a component
    all pairs are compared by their shingles, which are taken from ``texts`` (id, text_key, text) once more. A component of
    over ``most`` sets or ``weight`` shingles is cut into parts of about that size that meet two by two. ``repeats``:
    whether any two rows of ``texts`` agree in id and text.
    """
    buckets = nodes.select("fp", F.explode("keys").alias("bucket"))
    near = roots(linked_in(buckets, Links(STAGE_BITS, STAGE_DISTANCE, ()), few=16, order=("bucket", "fp")))
    near = near.withColumnRenamed("node", "fp").join(nodes.select("fp", "least", "shingles"), "fp")
    near = materialize_lean(near.select("fp", "root", "shingles", "least.id", "least.text_key"), "candidates")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("shingles") / weight)).cast("int")
    sizes = materialize_lean(near.groupBy("root").agg(parts.alias("parts")), "groups")
    rows = near.join(sizes, "root").select("fp", F.xxhash64("root").alias("bucket"), "parts", "id", "text_key")
    rows = materialize_lean(rows, "wanted")
    # Ids alone go first: mostly few enough to reach the texts without moving them.
    ids = materialize_lean(near.select(F.col("id").alias("near_id")).distinct().hint("rebalance"), "ids")
    few = texts.join(sent_if_small(ids, 16), texts["id"].eqNullSafe(ids["near_id"]), "left_semi")
    same = few["id"].eqNullSafe(rows["id"]) & (few["text_key"] == rows["text_key"])
    sets = few.join(rows, same).select("fp", "bucket", "parts", set_bytes("text").alias("set"))
    if repeats:  # a row that repeats gives its set once
        sets = sets.dropDuplicates(["fp", "bucket"])
    sets = materialize_lean(sets, "sets")
    return met(sets, "set", order=("bucket", "fp")).mapInArrow(by_bucket(similar_in_buckets), "a binary, b binary").distinct()


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, null last.

    A group is what pairs of a Jaccard similarity of 0.8 or more, over the sets of five-word shingles, connect.
    Rows without a word are no copies of each other's content and all stay. Rows that agree in id and text are one
    document, of which one row stays.
    """
    bound_batches(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.where(F.regexp_like(F.col(text_col), F.lit(SPACE_WORD))).select(
        F.col(id_col).alias("id"), key.alias("text_key"), F.col(text_col).alias("text")
    )
    rows = texts.select("id", "text_key", node_of("text").alias("node")).select("id", "text_key", "node.*")
    rows = materialize_lean(rows, "documents")
    repeats = not rows.groupBy("id", "text_key").count().where("count > 1").isEmpty()
    # Inside a component the first (id, text) stays; ids that repeat with other texts are told apart by the text's key.
    order = F.struct(F.col("id").isNull().alias("n"), "id", "text_key")
    rows = rows.withColumn("doc", order)
    found = cluster(rows, lambda nodes: verified(nodes, texts, repeats), "doc", "keys", "shingles")
    found = materialize(found.select("id", "text_key", (F.col("doc") == F.col("component_id")).alias("first")), "decided")
    gone = found.where(~F.col("first")).select("id", "text_key").distinct()
    twice = found.where("first").groupBy("id", "text_key").count().where("count > 1").drop("count")
    gone, twice = materialize_lean(gone, "copies"), materialize_lean(twice, "repeated")
    names = [unused_name(docs, n) for n in ("k", "i")]
    keyed = docs.withColumns({names[0]: key, names[1]: F.col(id_col)})

    def meets(right: DataFrame):
        return keyed[names[1]].eqNullSafe(right["id"]) & (keyed[names[0]] == right["text_key"])

    kept = keyed.join(sent_if_small(gone, 24), meets(gone), "left_anti")
    if not twice.isEmpty():
        once = keyed.join(twice, meets(twice), "left_semi").dropDuplicates(names)
        kept = kept.join(twice, kept[names[1]].eqNullSafe(twice["id"]) & (kept[names[0]] == twice["text_key"]), "left_anti")
        kept = kept.union(once)
    return kept.drop(*names)
