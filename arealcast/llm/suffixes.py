"""Repeated passages by a sparse suffix array over content-selected positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.llm.common import SPACE_WORD, unused_name
from arealcast.session import materialize

LENGTH = 50  # words of a passage that is looked for
GRAM = 5  # words of the k-mer whose hash selects a position
WINDOW = 24  # consecutive k-mers of which the least is selected
#: Words that two occurrences of a passage surely share from its first selected position on.
PREFIX = LENGTH - (WINDOW - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def span_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from every position on, by doubling: that of 2n words is made of two of n words."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, size, out, done = h, 1, np.zeros(n, np.uint64), 0
    while True:
        if length & size:
            out = _mix(out * _B + block[done : done + n])
            done += size
        if done == length:
            return out
        block = _mix(block[:-size] * _A + block[size:])
        size *= 2


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size : width - size + n])


def selected(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of k-mers that are the least of some ``WINDOW`` consecutive ones; equal ones are all selected.

    ``h``: hashes of the words of several texts, one behind the other; ``ends``: where each text ends. Whether a position
    is selected depends on the words around it alone, so all occurrences of a passage agree.
    """
    grams = span_hashes(h, GRAM)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = _sliding(grams, WINDOW, np.minimum)
    at = np.arange(n)
    least[at + WINDOW + GRAM - 1 > ends[np.searchsorted(ends, at, side="right")]] = 0  # reaches into the next text
    least = np.pad(least, WINDOW - 1)
    return np.flatnonzero(_sliding(least, WINDOW, np.maximum) == grams)


SUFFIX_ROWS = "key bigint, doc bigint, pos int"
PORTION = 1 << 18  # words or rows that are worked on at once


def _rows(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc", "pos"])


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc, text): hash of the first words of every suffix that begins at a selected position."""
    docs: list[int] = []
    sizes: list[int] = []
    hashes: list[int] = []

    def portion() -> pa.RecordBatch:
        h, ends = np.array(hashes, np.uint64), np.cumsum(sizes)
        at = selected(h, ends)
        text = np.searchsorted(ends, at, side="right")
        fits = at + PREFIX <= ends[text]
        at, text = at[fits], text[fits]
        keys = span_hashes(h, PREFIX)[at] if len(at) else np.zeros(0, np.uint64)
        return _rows(keys, np.array(docs, np.int64)[text], at - (ends - np.array(sizes))[text])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = text.split()
            if len(words) < LENGTH:
                continue
            docs.append(doc)
            sizes.append(len(words))
            hashes.extend(map(xxhash.xxh3_64_intdigest, words))
            if len(hashes) >= PORTION:
                yield portion()
                docs, sizes, hashes = [], [], []
    if docs:
        yield portion()


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc, text, positions): the matches are extended to the left and right.

    Every passage of LENGTH words whose first selected position is among ``positions`` comes out with its hash.
    """
    held, size = [], 0
    for batch in batches:
        doc, text, at = (batch.column(i) for i in range(3))
        for d, t, p in zip(doc.to_pylist(), text.cast(pa.binary()).to_pylist(), at.to_pylist()):
            words = t.split()
            n = len(words) - LENGTH + 1
            if n <= 0:
                continue
            p = np.array(p)
            change = np.zeros(n + 1, np.int32)
            np.add.at(change, np.minimum(n, np.maximum(0, p - WINDOW + 1)), 1)
            np.add.at(change, np.minimum(n, p + 1), -1)
            begins = np.flatnonzero(np.cumsum(change[:-1]))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            held.append((span_hashes(h, LENGTH)[begins], np.full(len(begins), d), begins))
            size += len(begins)
            if size >= PORTION:
                yield _rows(*map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield _rows(*map(np.concatenate, zip(*held)))


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a partition sorted by (key, doc, pos): the rows that have the key of the row before or behind.

    The first and last row are marked, as one neighbour of theirs lies in another partition. Rows of one place count
    once. A partition is three numbers a row, and the ranges keep partitions even.
    """
    batches = list(batches)
    rows = pa.Table.from_batches(batches) if batches else None
    if rows is None or not rows.num_rows:
        return
    key, doc, pos = (rows[c].to_numpy() for c in ("key", "doc", "pos"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    key, doc, pos = key[new], doc[new], pos[new]
    same = key[1:] == key[:-1]
    before, behind = np.concatenate(([False], same)), np.concatenate((same, [False]))
    edge = np.zeros(len(key), bool)
    edge[[0, -1]] = True
    use = before | behind | edge
    columns = [pa.array(x[use]) for x in (key, doc, pos, before, behind, edge)]
    yield from pa.table(columns, ["key", "doc", "pos", "before", "behind", "edge"]).to_batches(1 << 18)


def repeated_places(rows: DataFrame) -> DataFrame:
    """(doc, pos, first) of rows (key, doc, pos) whose key occurs at another place too; ``first``: at no earlier one.

    The rows are sorted globally by key and place, so that a key of any frequency spreads over as many partitions as
    its rows need; only neighbours are compared. ``rows`` has to be a written table, as its ranges are sampled first.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "key", "doc", "pos").sortWithinPartitions("key", "doc", "pos")
    schema = "key bigint, doc bigint, pos int, before boolean, behind boolean, edge boolean"
    compared = materialize(ordered.mapInArrow(compare_neighbours, schema), "neighbours")
    inner = compared.where("not edge and (before or behind)").select("doc", "pos", (~F.col("before")).alias("first"))
    # Two rows a partition are left, which find their neighbours among each other.
    edges = [(r.key, r.doc, r.pos, r.before, r.behind) for r in compared.where("edge").collect()]
    edges.sort()
    fixed = []
    for i, (key, doc, pos, before, behind) in enumerate(edges):
        before |= i > 0 and edges[i - 1][0] == key and edges[i - 1][:3] != (key, doc, pos)
        behind |= i + 1 < len(edges) and edges[i + 1][0] == key and edges[i + 1][:3] != (key, doc, pos)
        if before or behind:
            fixed.append((doc, pos, not before))
    return inner.union(rows.sparkSession.createDataFrame(fixed, "doc bigint, pos int, first boolean"))


def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (doc, begins, firsts): maximal runs of words that repeated windows cover, and the words of them to cut."""
    for batch in batches:
        out: list[tuple] = []
        for doc, begins, firsts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            order = np.argsort(begins)
            b, later = np.array(begins)[order], ~np.array(firsts)[order]
            cuts = _union(b[later])
            for start, end in _union(b):
                inside = [(x, y) for x, y in cuts if start <= x and y <= end]
                out.append((doc, start, end, [list(c) for c in inside]))
        if out:
            doc, start, end, cut = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(cut, pa.list_(pa.list_(pa.int32())))],
                ["doc", "start_word", "end_word", "cuts"],
            )


def _union(begins: np.ndarray) -> list[tuple[int, int]]:
    if not len(begins):
        return []
    gap = np.flatnonzero(np.diff(begins) > LENGTH)
    starts, lasts = np.concatenate(([0], gap + 1)), np.concatenate((gap, [len(begins) - 1]))
    return [(int(begins[s]), int(begins[e]) + LENGTH) for s, e in zip(starts, lasts)]


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """Rows (id, doc, text), where ``doc`` tells rows apart and orders them, and whether it is simply the id.

    It is the id where ids are BIGINT, present and distinct, else a hash of id and text.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(id_col)).alias("ids")).first()
    plain = dict(docs.dtypes)[id_col] == "bigint" and ids.rows == ids.ids
    return docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col, plain), text_of(text_col)), plain


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).alias("text")


def row_key(id_col: str, text_col: str, plain: bool) -> Column:
    return (F.col(id_col) if plain else F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text_of(text_col))).alias("doc")


@F.arrow_udf(T.IntegerType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(x.split()) for x in texts.cast(pa.binary()).to_pylist()], pa.int32())


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Of (doc, text): (doc, start_word, end_word, cuts), one row per maximal run of words under repeated passages.

    Equal texts are one text in the search. Of such a group all words are repeated, and all but the first one's are cut.
    """
    texts = materialize(rows.select("doc", F.md5("text").alias("same"), _n_words("text").alias("n")).distinct(), "texts")
    groups = texts.where(F.col("n") >= LENGTH).groupBy("same").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("k"))
    copies = texts.join(materialize(groups.where("k > 1").drop("k"), "groups"), "same").select("doc", "n", "least")
    copies = materialize(copies, "copies")
    later = materialize(copies.where("doc != least").select("doc"), "later")
    once = rows.join(later, "doc", "left_anti")

    found = materialize(once.select("doc", "text").mapInArrow(suffixes, SUFFIX_ROWS), "suffixes")
    # Positions of one document only, so the lists are bounded by a text's length. Ids alone go first: mostly few enough
    # to reach the texts without moving them.
    shared = materialize(repeated_places(found).groupBy("doc").agg(F.collect_set("pos").alias("at")), "positions")
    ids = materialize(shared.select("doc"), "ids")
    longer = once.join(ids, "doc", "left_semi").join(shared, "doc").select("doc", "text", "at")
    again = repeated_places(materialize(longer.mapInArrow(windows, SUFFIX_ROWS), "windows"))
    by_doc = again.groupBy("doc").agg(F.collect_list(F.struct("pos", "first")).alias("w"))
    by_doc = by_doc.select("doc", F.col("w.pos").alias("begins"), F.col("w.first").alias("firsts"))
    spans = by_doc.mapInArrow(spans_of, "doc bigint, start_word int, end_word int, cuts array<array<int>>")
    spans = materialize(spans, "spans")

    firsts = copies.where("doc = least")
    whole = F.lit(0).alias("start_word"), F.col("n").alias("end_word")
    cuts = spans.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cuts"))
    none = F.array().cast("array<array<int>>")
    return (
        spans.join(firsts, "doc", "left_anti")
        .union(firsts.join(cuts, "doc", "left").select("doc", *whole, F.coalesce("cuts", none)))
        .union(copies.where("doc != least").select("doc", *whole, F.array(F.array(F.lit(0), "n"))))
    )


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of 50 or more words that occur at another place of the collection too, in the same or another text.

    One row per maximal span of such words: doc_id, start_word, end_word (words from 0, split at white space; the end is
    exclusive), n_cut: words of the span that an earlier place has as well, in order of id and position. Cutting those
    everywhere leaves every passage once. All occurrences are found, whatever their number. Texts of under 50 words and
    null texts have no spans. Rows that agree in id and text are one document; rows that share an id but not the text
    are told apart, and each span carries its row's id.
    """
    rows, plain = told_apart(docs, id_col, text_col)
    n_cut = F.aggregate("cuts", F.lit(0), lambda s, c: s + c[1] - c[0])
    out = repeated_spans(rows).select("doc", "start_word", "end_word", n_cut.alias("n_cut"))
    if plain:
        return out.withColumnRenamed("doc", "doc_id")
    ids = rows.select(F.col("id").alias("doc_id"), "doc").distinct()
    return out.join(ids, "doc").select("doc_id", "start_word", "end_word", "n_cut")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: bytes, cuts: list[list[int]]) -> bytes:
    """``text`` without the words of the ranges ``cuts`` (disjoint, in order) and the white space behind each range."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in cuts:
        out.append(text[at : words[start][0]])
        at = words[end][0] if end < len(words) else len(text)
    return b"".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    pairs = zip(texts.cast(pa.binary()).to_pylist(), cuts.to_pylist())
    return pa.array([t if t is None or not c else cut_words(t, c) for t, c in pairs], pa.binary()).cast(pa.string())


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every repeated passage left at its first place only; all columns stay, ``size_col`` follows the text.

    A document whose whole text stands elsewhere loses its row; others keep theirs unchanged.
    """
    rows, plain = told_apart(docs, id_col, text_col)
    spans = repeated_spans(rows).where(F.size("cuts") > 0)
    in_order = F.array_sort(F.flatten(F.collect_list("cuts")))
    cuts = materialize(spans.groupBy("doc").agg(in_order.alias("cuts")), "cuts")
    key, cut = unused_name(docs, "doc"), unused_name(docs, "cuts")
    keyed = docs.withColumn(key, row_key(id_col, text_col, plain))
    joined = keyed.join(cuts.select(F.col("doc").alias(key), F.col("cuts").alias(cut)), key, "left")
    shorter = _cut(F.col(text_col), F.col(cut))
    whole = F.col(cut).isNull()
    sizes = {size_col: F.when(whole, F.col(size_col)).otherwise(F.length(shorter))} if size_col in docs.columns else {}
    out = joined.withColumns({text_col: F.when(whole, F.col(text_col)).otherwise(shorter), **sizes})
    return out.where(whole | F.regexp_like(F.col(text_col), F.lit(SPACE_WORD))).select(*[F.col(f"`{c}`") for c in docs.columns])
