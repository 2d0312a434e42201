"""Repeated word sequences by a compacted de Bruijn graph over words.

Edges of the graph are k-mers of words. Of every window of ``SPAN`` words at least one k-mer is kept (the least hash of
those in the window), the same one wherever the window stands, so a sparse set of edges shows every repeated window.
Two edges that follow each other at all their places and nowhere else lie on a path without branches; such paths are
compacted, and a compacted path is one unit of work however long it is. Only windows that cross the end of a path are
looked at one by one. Paths and windows are compared by the 128-bit hash of their words, read from the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.llm.common import materialize_lean
from arealcast.llm.suffixes import span_hashes

SPAN = 20  # words of a window
K = 8  # words of a k-mer
KMERS = SPAN - K + 1  # k-mers of a window
PORTION = 1 << 17  # words that are worked on at once
LAST = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)

EDGE_ROWS = "kmer bigint, next bigint, ord bigint, ver bigint, at bigint"
WINDOW_ROWS = "h1 bigint, h2 bigint, ord bigint, ver bigint, start int, length int"


# ---------------------------------------------------------------- texts
def split_words(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of every text, one text at a time."""
    for i in range(len(texts)):
        yield (texts[i].as_py() or b"").split()


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("sha", T.StringType())]))
def word_digest(texts: pa.Array) -> pa.Array:
    """Number of words, and SHA-256 of the words joined by one space."""
    n, sha = [], []
    for words in split_words(texts.cast(pa.binary())):
        n.append(len(words))
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["n", "sha"])


# ---------------------------------------------------------------- edges
def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size : width - size + n])


def selected(kmers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of k-mers that are the least in a window of one text; equal ones are all selected.

    ``kmers``: one behind the other for several texts that end (in words) at ``ends``.
    """
    n = len(kmers) - KMERS + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = _sliding(kmers, KMERS, np.minimum)
    at = np.arange(n)
    least[at + SPAN > ends[np.searchsorted(ends, at, side="right")]] = 0  # reaches into the next text
    return np.flatnonzero(_sliding(np.pad(least, KMERS - 1), KMERS, np.maximum) == kmers)


def _edges(ids: list[tuple[int, int]], sizes: list[int], hashes: list[int]) -> pa.RecordBatch:
    ends = np.cumsum(sizes)
    kmers = span_hashes(np.array(hashes, np.uint64), K)
    at = selected(kmers, ends)
    text = np.searchsorted(ends, at, side="right")
    own = kmers[at]
    follow = np.zeros(len(at), np.uint64)
    gap = np.zeros(len(at), np.int64)
    if len(at) > 1:
        i = np.flatnonzero(text[1:] == text[:-1])
        gap[i] = at[i + 1] - at[i]  # at most KMERS, so three k-mers cover all words from one to the next
        follow[i] = (own[i] * _MIX ^ kmers[at[i + 1] - np.minimum(K, gap[i])]) * _MIX ^ own[i + 1] * _MIX + gap[i].astype(np.uint64)
    place = at - (ends - np.array(sizes))[text]
    ord_, ver = (np.array([d[c] for d in ids], np.int64)[text] for c in (0, 1))
    columns = [own.view(np.int64), follow.view(np.int64), ord_, ver, place << 8 | gap]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kmer", "next", "ord", "ver", "at"])


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (ord, ver, text): the selected k-mers, a hash of what follows up to the next one, and their places."""
    ids: list[tuple[int, int]] = []
    sizes: list[int] = []
    hashes: list[int] = []
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for key, words in zip(keys, split_words(batch.column(2).cast(pa.binary()))):
            if len(words) < SPAN:
                continue
            ids.append(key)
            sizes.append(len(words))
            hashes.extend(map(xxhash.xxh3_64_intdigest, words))
            if len(hashes) >= PORTION:
                yield _edges(ids, sizes, hashes)
                ids, sizes, hashes = [], [], []
    if ids:
        yield _edges(ids, sizes, hashes)


# ---------------------------------------------------------------- compaction
def paths(pos: np.ndarray, gap: np.ndarray, n: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of every compacted path at its place in one text.

    ``pos``: sorted places of the text's repeated edges; ``n``: how often the edge stands anywhere; ``alone``: whether the
    same words follow it everywhere, up to the same next edge. If so and the next edge stands as often, it stands
    nowhere else, and the two are one path at all places of both.
    """
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = alone[:-1] & (n[:-1] == n[1:]) & (pos[:-1] + gap[:-1] == pos[1:])
    cut = np.flatnonzero(~joined)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(pos) - 1]))
    return pos[first], pos[last] + K


def places(n_words: int, pos: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of what has to be compared: long paths as wholes, and windows with a repeated edge that no path holds."""
    n = n_words - SPAN + 1
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.minimum(n, np.maximum(0, pos + K - SPAN)), 1)
    np.add.at(change, np.minimum(n, pos + 1), -1)
    wanted = np.cumsum(change[:-1]) > 0
    long = end - start >= SPAN
    start, end = start[long], end[long]
    held = np.zeros(n + 1, np.int32)
    np.add.at(held, start, 1)
    np.add.at(held, end - SPAN + 1, -1)
    windows = np.flatnonzero(wanted & (np.cumsum(held[:-1]) == 0))
    begins = np.concatenate((start, windows))
    lengths = np.concatenate((end - start, np.full(len(windows), SPAN)))
    order = np.argsort(begins, kind="stable")
    return begins[order], lengths[order]


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (ord, ver, text, marks): hash and place of every path and window that has to be compared.

    What stands earlier in the same text already is repeated for certain; it comes out without a hash, merged to ranges.
    """
    held: list[tuple] = []
    size = 0
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for (ord_, ver), words, marks in zip(keys, split_words(batch.column(2).cast(pa.binary())), batch.column(3)):
            if len(words) < SPAN:
                continue
            at, n, alone = (np.array(marks.values.field(c).to_numpy(zero_copy_only=False)) for c in ("at", "n", "alone"))
            order = np.argsort(at)
            at, n, alone = at[order], n[order], alone[order].astype(bool)
            pos = at >> 8
            begins, lengths = places(len(words), pos, *paths(pos, at & 255, n, alone))
            joined = b" ".join(words)
            tail = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            head = np.concatenate(([0], tail[:-1] + 1))
            digest = xxhash.xxh3_128_digest
            raw = [digest(joined[a:b]) for a, b in zip(head[begins].tolist(), tail[begins + lengths - 1].tolist())]
            seen: set[bytes] = set()
            fresh = np.fromiter((not (d in seen or seen.add(d)) for d in raw), bool, len(raw))
            again = ranges(begins[~fresh], lengths[~fresh])
            h = np.frombuffer(b"".join(raw), ">i8").reshape(-1, 2)[fresh]
            held.append((h, ord_, ver, begins[fresh], lengths[fresh], again))
            size += len(h) + len(again)
            if size >= PORTION:
                yield _window_batch(held)
                held, size = [], 0
    if held:
        yield _window_batch(held)


def _window_batch(held: list[tuple]) -> pa.RecordBatch:
    n_fresh = [len(x[3]) for x in held]
    n_again = [len(x[5]) for x in held]
    h = np.concatenate([x[0] for x in held]).astype(np.int64)
    again = np.concatenate([x[5] for x in held])
    none = [None] * len(again)
    key = lambda c: np.concatenate((np.repeat([x[c] for x in held], n_fresh), np.repeat([x[c] for x in held], n_again)))
    place = lambda c, k: np.concatenate((np.concatenate([x[c] for x in held]), again[:, k])).astype(np.int32)
    hashes = [pa.concat_arrays([pa.array(h[:, c], pa.int64()), pa.array(none, pa.int64())]) for c in (0, 1)]
    columns = [*hashes, pa.array(key(1), pa.int64()), pa.array(key(2), pa.int64()), pa.array(place(3, 0)), pa.array(place(4, 1))]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "ord", "ver", "start", "length"])


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Union of ranges as rows (start, length), disjoint and in order."""
    if not len(begins):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate((begins + lengths)[order])
    new = np.flatnonzero(begins[1:] > reach[:-1]) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(begins) - 1]))
    return np.stack([begins[first], reach[last] - begins[first]], axis=1)


# ---------------------------------------------------------------- what is cut
def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (ord, ver, text, cuts): number of cut words and SHA-256 of the others."""
    for batch in batches:
        gone, sha = [], []
        for words, cuts in zip(split_words(batch.column(2).cast(pa.binary())), batch.column(3).to_pylist()):
            merged = ranges(*np.array([(c["start"], c["length"]) for c in cuts], np.int64).T)
            kept: list[bytes] = []
            at = 0
            for start, length in merged.tolist():
                kept += words[at:start]
                at = start + length
            kept += words[at:]
            gone.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["ord", "ver", "n_removed", "sha"])


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(ord, ver, cuts): the ranges of words of each text (ord, ver, text) that a text of a smaller ``ord``, or an earlier
    place of the same text, has too, in runs of ``SPAN`` words or more."""
    found = materialize_lean(texts.mapInArrow(edges, EDGE_ROWS), "edges")
    # Hot k-mers shrink to one row a task before they are shuffled.
    kept = found.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("lo"), F.max("next").alias("hi"))
    kept = kept.where("n > 1").select("kmer", "n", (F.col("lo").eqNullSafe(F.col("hi")) & (F.col("lo") != 0)).alias("alone"))
    repeated = found.join(kept, "kmer").select("ord", "ver", F.struct("at", "n", "alone").alias("mark"))
    # At most as many entries as the text has words; rows that repeat give the same entries.
    marks = repeated.groupBy("ord", "ver").agg(F.collect_set("mark").alias("marks"))
    marks = materialize_lean(marks, "marks")
    compared = texts.join(marks, ["ord", "ver"]).select("ord", "ver", "text", "marks").mapInArrow(windows, WINDOW_ROWS)
    compared = materialize_lean(compared, "windows")
    within = compared.where("h1 is null").select("ord", "ver", "start", "length")
    across = compared.where("h1 is not null")
    first = across.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("last > first")
    later = across.join(first.drop("last"), ["h1", "h2"]).where("ord > first").select("ord", "ver", "start", "length")
    by_text = within.union(later).groupBy("ord", "ver").agg(F.collect_set(F.struct("start", "length")).alias("cuts"))
    return materialize_lean(by_text, "cuts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are split at ASCII white space and compared unchanged. A word goes if a run of 20 words that holds it also
    stands in a document of a smaller id or earlier in its own document. Null texts have no words; texts of fewer than 20
    words lose none. A null id counts as the largest. Rows that share an id are documents of their own of which none is
    earlier than another; rows that agree in id and text get the same result.
    """
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    base = docs.select(F.col(id_col).alias("doc_id"), ord_, text)
    rows = base.select("doc_id", "ord", word_digest("text").alias("d")).select("doc_id", "ord", "d.*")
    rows = materialize_lean(rows, "rows")
    # Ids with several texts are rare; their texts are told apart by their digest.
    several = rows.groupBy("ord").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a != b").select("ord")
    several = materialize_lean(several.withColumn("several", F.lit(True)), "several")
    if several.isEmpty():
        texts = base.select("ord", F.lit(0).cast("long").alias("ver"), "text")
        rows = rows.withColumn("ver", F.lit(0).cast("long"))
    else:
        ver = F.when(F.col("several"), F.xxhash64("sha")).otherwise(F.lit(0).cast("long")).alias("ver")
        texts = base.join(several, "ord", "left").withColumn("sha", word_digest("text")["sha"]).select("ord", ver, "text")
        rows = rows.join(several, "ord", "left").select("doc_id", "ord", "n", "sha", ver)
    cuts = repeated_ranges(texts)
    shorter = texts.join(cuts, ["ord", "ver"]).select("ord", "ver", "text", "cuts")
    shorter = shorter.mapInArrow(cut, "ord bigint, ver bigint, n_removed bigint, sha string").distinct()
    shorter = materialize_lean(shorter.withColumnRenamed("sha", "kept"), "shorter")
    return rows.join(shorter, ["ord", "ver"], "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )
