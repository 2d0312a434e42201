"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.llm.samples import held_out, labelled_sample

#: Labelled rows of each class that the dictionaries and the thresholds are learned from, at most; whole texts.
TOXIC_ROWS, ORDINARY_ROWS = 1000, 2000
#: Sizes that the trainer of zstandard aims at, and the stretches of ordinary text it is shown at most, evenly spread.
ORDINARY_BYTES, PASSAGE_BYTES, STRETCHES = 4096, 2048, 30_000
#: Words of a window of neighbouring words, and from one window's start to the next.
SPAN, STRIDE = 8, 8
TIMES = 3  # a window is a word so many times: its first place costs its literals or a match, the others next to nothing
REMEMBERED = 300_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes  # words and their beginnings
    passages: bytes  # trained on passages of toxic texts
    ordinary: bytes  # trained on ordinary texts
    weights: tuple[float, ...]  # of the document's features, bias first


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def window(word: bytes) -> bytes:
    return b" " + (word + b" ") * TIMES


def spans(words: Sequence[bytes]) -> Iterator[bytes]:
    """Windows of ``SPAN`` neighbouring words; together they hold every word, and the last one ends with the text."""
    for i in range(0, max(1, len(words) - SPAN + STRIDE) if words else 0, STRIDE):
        yield b" " + b" ".join(words[i : i + SPAN]) + b" "


class Distance(dict):
    """Bytes that a window is shorter after a toxic dictionary than after the ordinary one alone.

    By word: the gain of the word's window, remembered. ``spanned``: the gains of windows of neighbouring words. A toxic
    dictionary goes on with the ordinary one, at the same distances, so that the two differ only where toxic text helps.
    """

    def __init__(self, model: Model):
        self.ordinary = self._compressor(model.ordinary)
        self.toxic = self._compressor(model.toxic + model.ordinary)
        self.passages = self._compressor(model.passages + model.ordinary)

    def spanned(self, words: Sequence[bytes]) -> list[int]:
        ordinary, passages = self.ordinary.compress, self.passages.compress
        return [len(ordinary(x)) - len(passages(x)) for x in spans(words)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        # Matches of five bytes on, searched exhaustively: a single word tells, its common endings do not.
        reach = max(15, len(content).bit_length() + 1)  # the whole dictionary lies within the window
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, min_match=5, window_log=reach, hash_log=15, chain_log=16, search_log=7,
            target_length=64, write_content_size=False, write_dict_id=False,
        )
        content_only = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=content_only, compression_params=how)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = window(word)
        out = len(self.ordinary.compress(x)) - len(self.toxic.compress(x))
        if len(word) <= 64:
            self[word] = out
        return out


#: Gains from which a window of one word and one of several count, each by itself.
GAINS, SPAN_GAINS = (1, 2, 4), (2, 4, 8)
FEATURES = 3 * (len(GAINS) + len(SPAN_GAINS))


def document_features(distance: Distance, text: bytes) -> tuple[float, ...]:
    """Of the text's windows of each kind: whether any, how many (logarithm) and which share (root) gain so many bytes."""
    words = words_of(text)
    one = np.fromiter(map(distance.__getitem__, words), np.int64, len(words))
    out: list[float] = []
    for gains, levels in ((one, GAINS), (np.array(distance.spanned(words), np.int64), SPAN_GAINS)):
        for least in levels:
            k = int(np.count_nonzero(gains >= least))
            out += [float(k > 0), float(np.log1p(k)), float(np.sqrt(k / max(1, len(gains))))]
    return tuple(out)


def contexts(texts: Sequence[bytes]) -> dict[bytes, int]:
    """Number of different pairs of neighbours of each word: copies of one passage count once."""
    number: dict[bytes, int] = {b"": 0}
    parts = []
    for text in texts:
        ids = [0, *(number.setdefault(w, len(number)) for w in words_of(text)), 0]
        x = np.array(ids, np.int64)
        parts.append(np.stack([x[1:-1], x[:-2], x[2:]], axis=1))
    if not parts:
        return {}
    rows = np.concatenate(parts)
    u = rows.astype(np.uint64)
    around = (u[:, 1] * np.uint64(0x9E3779B97F4A7C15) + u[:, 2] * np.uint64(0x165667B19E3779F9)) >> np.uint64(24)
    key = np.unique((u[:, 0] << np.uint64(40)) | around)
    counts = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(number))
    return {w: int(counts[i]) for w, i in number.items() if i}


def units_of(word: bytes) -> list[bytes]:
    """What the dictionary may hold of a word: its beginnings of 4 to 10 bytes, and the whole word with the blank behind it."""
    return [word[:k] for k in range(4, min(10, len(word)) + 1)] + [word + b" "]


def telling_units(
    toxic: Sequence[bytes], ordinary: Sequence[bytes], least: int = 5, odds: float = 8.0, z: float = 6.0
) -> list[bytes]:
    """Words and beginnings of words whose contexts lie in toxic texts far more often than in others, most contexts first.

    Of units that begin alike the one with most contexts stays. None is left out for want of room.
    """
    a, b = contexts(toxic), contexts(ordinary)
    n_a, n_b = max(1, sum(a.values())), max(1, sum(b.values()))
    units: dict[bytes, int] = {}
    for word, k in a.items():
        for u in units_of(word):
            units[u] = units.get(u, 0) + k
    units = {u: k for u, k in units.items() if k >= least}
    other = dict.fromkeys(units, 0)
    for word, k in b.items():
        for u in units_of(word):
            if u in other:
                other[u] += k
    chosen: list[tuple[int, bytes]] = []
    for u, k in sorted(units.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        chance = (k + other[u]) * n_a / (n_a + n_b)
        if k / n_a < odds * (other[u] + 0.5) / n_b or (k - chance) / np.sqrt(chance) <= z:
            continue
        if not any(u.startswith(v) for _, v in chosen):
            chosen.append((k, u))
    # As long as nearly all of its places go on alike, the whole of what goes on counts.
    return [max((u for u, n in units.items() if u.startswith(v) and n >= 0.85 * k), key=len) for k, v in chosen]


def word_content(units: Sequence[bytes]) -> bytes:
    """The toxic dictionary of single words; the most frequent come last, nearest to the window."""
    return b"".join(b" " + u for u in reversed(units)) + b" "


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary by the trainer of zstandard, or the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def passage_content(toxic: Iterable[bytes], units: Sequence[bytes], around: int = 3) -> bytes:
    """The toxic dictionary of passages, trained on what stands around the telling words of toxic texts.

    The trainer picks stretches that are common in its samples; in whole toxic texts these are mostly the common stretches
    of the language, which tell nothing.
    """
    heads, lengths = set(units), sorted({len(u) for u in units})
    samples = []
    for text in toxic:
        words = words_of(text)
        for i, w in enumerate(words):
            if any((w + b" ")[:k] in heads for k in lengths):
                samples.append(b" " + b" ".join(words[max(0, i - around) : i + around + 1]) + b" ")
    return trained(samples, PASSAGE_BYTES)


def ordinary_content(texts: Iterable[bytes]) -> bytes:
    """The ordinary dictionary, trained on stretches of ordinary text."""
    samples = []
    for text in texts:
        words = words_of(text)
        samples += [b" ".join(words[i : i + 12]) + b" " for i in range(0, len(words), 12)]
    return trained(samples[:: max(1, len(samples) // STRETCHES)], ORDINARY_BYTES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def dictionaries(rows: Sequence[tuple[bytes, int]]) -> Model:
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    units = telling_units(toxic, ordinary)
    return Model(word_content(units), passage_content(toxic, units), ordinary_content(ordinary) or b" ", ())


def fit(rows: Sequence[tuple[bytes, int]], counts: tuple[int, int] | None = None) -> Model:
    """Dictionaries from two thirds of the rows, and thresholds calibrated so that 0.3 is a probability.

    Rows are never calibrated on with dictionaries that were made of them: each third is measured by dictionaries of the
    other two, and one logistic fit takes all thirds together. ``counts``: ordinary and toxic documents that ``rows`` were
    drawn from, by class; without them the rows are all. The draw changes the odds of the classes and with them the bias
    only, which is moved back by the logarithm of that change.
    """
    y = np.array([float(v) for _, v in rows])
    n_ordinary, n_toxic = counts or (int(len(y) - y.sum()), int(y.sum()))
    if len(set(y)) < 2 or len(rows) < 3:
        share = (n_toxic + 0.5) / (n_ordinary + n_toxic + 1) if rows else 0.0
        bias = float(np.log(share / (1 - share))) if 0 < share < 1 else -30.0
        return replace(dictionaries(rows), weights=(bias, *[0.0] * FEATURES))
    measured = np.zeros((len(rows), FEATURES))
    for third in (0, 1, 2):
        model = dictionaries([r for i, r in enumerate(rows) if i % 3 != third])
        distance = Distance(model)
        for i in range(third, len(rows), 3):
            measured[i] = document_features(distance, rows[i][0])
    w = logistic(measured, y)
    if n_ordinary and n_toxic:
        w[0] += np.log(n_toxic / n_ordinary) - np.log(y.sum() / (len(y) - y.sum()))
    return replace(model, weights=tuple(float(v) for v in w))


@functools.lru_cache(maxsize=2)
def distance_of(model: Model) -> Distance:
    return Distance(model)


def fit_from(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """A model from at most so many labelled rows of each class, none of them held out.

    How frequent the classes are is counted over all labelled rows that are open, so that the limits do not move the scores.
    """
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    open_ = docs.where(~held_out(F.col("doc_id")))
    rows = [
        labelled_sample(open_, known.where(F.col("toxic") == k), "toxic", most) for k, most in ((1, toxic_rows), (0, ordinary_rows))
    ]
    distinct = known.where(F.col("toxic").isin(0, 1)).distinct()
    met = open_.where(F.length("text") > 0).select("doc_id").join(distinct, "doc_id").groupBy("toxic").count()
    found = {r["toxic"]: r["count"] for r in met.collect()}
    both = [*rows[0], *rows[1]]
    order = np.random.default_rng(3).permutation(len(both))
    return fit([both[i] for i in order], (found.get(0, 0), found.get(1, 0)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Every word of the whole text is a window, and so is every run of ``SPAN`` words, one each ``STRIDE`` words. Texts without a word, null ones too, get the score of a text without
    toxic windows. Without labels of both classes every score is the share of the one that there is, or 0.
    """
    model = fit_from(docs, labels)

    def scored(texts: pa.Array) -> pa.Array:
        distance = distance_of(model)
        x = np.array([document_features(distance, t or b"") for t in texts.cast(pa.binary()).to_pylist()]).reshape(-1, FEATURES)
        w = np.array(model.weights)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30))), pa.float64())

    score = F.arrow_udf(scored, T.DoubleType())
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
