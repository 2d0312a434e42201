"""Languages of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealcast.llm.samples import held_out, labelled_sample

UNDETERMINED = "und"
#: Labelled rows that a model is fitted on, at most; their texts are taken whole.
#: Rows learned from at least of every language, and languages that get them.
EACH_LANGUAGE, LANGUAGES = 20, 100
SAMPLE_ROWS = 1200
BUCKETS = 1 << 17
ORDERS = 4  # n-grams of two to so many bytes; those with a blank in them are the affixes
SLAB, PORTION = 100_000, 4_000_000  # words whose features, and bytes of text whose marginals, are in memory at once
_M = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Crf:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, languages), of n-grams, affixes and whole words
    transitions: np.ndarray  # log potentials, from row to column


def features(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, and where each word's begin.

    Every byte of a word gives the n-grams that begin at the byte before it, so a blank in an n-gram marks the word's
    beginning or end; further, each word gives one feature of its whole, its entry in the lexicon.
    """
    raw = np.frombuffer(b" " + b" ".join(words) + b"    ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum()) + len(words) + 1
    word_of = np.cumsum(raw[:n] == 32) - 1
    inside = np.flatnonzero(raw[:n] != 32)
    code = raw[inside - 1].astype(np.uint32)
    columns = []
    for order in range(2, ORDERS + 1):
        code = code * np.uint32(257) + raw[inside + order - 2]
        columns.append(_bucket(code, order))
    at = np.cumsum(sizes) - sizes
    # Whole words: sums of bytes weighted by their place.
    place = np.arange(len(inside)) - at[word_of[inside]]
    term = (raw[inside].astype(np.uint32) + np.uint32(1)) * ((place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) * _M)
    term ^= term >> np.uint32(13)
    whole = _bucket(np.add.reduceat(term * _M, at) if len(at) else term, 9)
    grams = np.stack(columns, axis=1)
    width = ORDERS - 1
    flat = np.empty(grams.size + len(words), np.int64)
    begins = at * width + np.arange(len(words))
    last = begins + sizes * width
    mask = np.ones(len(flat), bool)
    mask[last] = False
    flat[mask], flat[last] = grams.ravel(), whole
    return flat, begins


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    h = (code + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * _M
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(15)).astype(np.int64) & (BUCKETS - 1)


def emissions(model: Crf, words: Sequence[bytes]) -> np.ndarray:
    out = np.empty((len(words), len(model.languages)), np.float32)
    for low in range(0, len(words), SLAB):
        flat, begins = features(words[low : low + SLAB])
        out[low : low + SLAB] = np.add.reduceat(model.weights[flat], begins, axis=0)
    return out


def passes(model: Crf, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Emission factors, transition factors, and the forward and backward vectors of every word, each scaled by itself.

    Texts of ``sizes`` words (at least one) lie one behind the other. All go step by step together, the longest first, so
    that those still running are a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(model.transitions - model.transitions.max()).astype(np.float32)
    running = len(length) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
    forward, backward = np.empty_like(e), np.empty_like(e)
    state = e[start]
    for t, k in enumerate(running):
        if t:
            state = (state[:k] @ a) * e[start[:k] + t]
        state /= state.sum(axis=1, keepdims=True)
        forward[start[:k] + t] = state
    back = np.ones_like(e[start])
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        more = running[t + 1] if t + 1 < len(running) else 0
        if more:
            at = start[:more] + t + 1
            b = (e[at] * back[:more]) @ a.T
            back[:more] = b / b.sum(axis=1, keepdims=True)
        backward[start[:k] + t] = back[:k]
    return e, a, forward, backward


def marginals(model: Crf, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posterior of each word's language by forward-backward; texts of ``sizes`` words lie one behind the other."""
    _, _, forward, backward = passes(model, scores, sizes)
    p = forward * backward
    return p / p.sum(axis=1, keepdims=True)


def expected(model: Crf, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word's language, and the expected number of every transition over all texts."""
    e, a, forward, backward = passes(model, scores, sizes)
    p = forward * backward
    first = np.zeros(len(e), bool)
    first[np.cumsum(sizes) - sizes] = True
    b = np.flatnonzero(~first)
    pair = forward[b - 1][:, :, None] * a[None] * (e[b] * backward[b])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p / p.sum(axis=1, keepdims=True), pair.sum(axis=0, dtype=np.float64)


def fit(rows: Sequence[tuple[bytes, str]], epochs: int = 2, seed: int = 5) -> Crf:
    """Fit on texts with one label each, mixed into code-switched sequences.

    Texts are cut into stretches of 5 to 40 words, which are shuffled and joined, so that transitions are learned from
    switches that are known. Weights begin as log frequencies and follow the gradient of the conditional likelihood.
    """
    languages = tuple(sorted({label for _, label in rows}))
    n_lang = len(languages)
    if not n_lang:
        return Crf((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    stretches: list[tuple[list[bytes], int]] = []
    for text, label in rows:
        words = text.split()
        at = 0
        while at < len(words):
            step = int(rng.integers(5, 41))
            stretches.append((words[at : at + step], number[label]))
            at += step
    rng.shuffle(stretches)
    count = np.zeros((BUCKETS, n_lang))
    for i in range(n_lang):
        words = [w for s, label in stretches if label == i for w in s]
        for low in range(0, len(words), SLAB):
            count[:, i] += np.bincount(features(words[low : low + SLAB])[0], minlength=BUCKETS)
    rate = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * BUCKETS))
    weights = (0.2 * (rate - rate.mean(axis=1, keepdims=True))).astype(np.float32)
    model = Crf(languages, weights, np.eye(n_lang, dtype=np.float32) * 2)
    per_batch = 400
    moved, moved_t = np.full((BUCKETS, n_lang), 1e-2, np.float32), np.full((n_lang, n_lang), 1e-2, np.float32)
    for _ in range(epochs):
        for low in range(0, len(stretches), per_batch):
            part = stretches[low : low + per_batch]
            words = [w for s, _ in part for w in s]
            gold = np.repeat([label for _, label in part], [len(s) for s, _ in part])
            # Sequences of ten stretches.
            sizes = np.array([sum(len(s) for s, _ in part[k : k + 10]) for k in range(0, len(part), 10)])
            flat, begins = features(words)
            scores = np.add.reduceat(model.weights[flat], begins, axis=0)
            p, pairs = expected(model, scores, sizes)
            error = -p
            error[np.arange(len(gold)), gold] += 1
            each = np.diff(np.append(begins, len(flat)))
            spread = np.repeat(error, each, axis=0)
            seen, where = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, i], len(seen)) for i in range(n_lang)], axis=1) / len(words) * 100
            moved[seen] += g * g
            model.weights[seen] += (0.05 * g / np.sqrt(moved[seen])).astype(np.float32)
            # Transitions: observed pairs minus expected ones.
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(sizes) - sizes] = False
            b = np.flatnonzero(inner)
            want = np.zeros((n_lang, n_lang))
            np.add.at(want, (gold[b - 1], gold[b]), 1)
            gt = (want - pairs) / len(words) * 100
            moved_t += gt * gt
            model.transitions[:] += (0.05 * gt / np.sqrt(moved_t)).astype(np.float32)
    return model


def _portions(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Texts by size, long ones together: (their places, all their words, their numbers of words).

    Only the texts of one portion are split into words at a time.
    """
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (size == 0 or size + len(texts[order[end]]) <= PORTION):
            size += len(texts[order[end]])
            end += 1
        part = [(i, ws) for i in order[at:end] if (ws := texts[i].split())]
        at = end
        if part:
            yield [i for i, _ in part], [w for _, ws in part for w in ws], np.array([len(ws) for _, ws in part])


def label_texts(model: Crf, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Place of each text that has words, and the marginals of its words."""
    for places, words, sizes in _portions(texts):
        p = marginals(model, emissions(model, words), sizes)
        for i, a, b in zip(places, np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            yield i, p[a:b]


def with_languages(docs: DataFrame, model: Crf, text_col: str = "text", name: str = "lang_found") -> DataFrame:
    """``docs`` with the struct ``name``: lang (``und`` without a letter), score, and word_langs, one per word.

    ``score`` is the language's mean marginal over the words. Null texts are ``und`` with score 0 and no words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS rows

    @F.arrow_udf("struct<lang:string,score:double,word_langs:array<string>>")
    def find(texts: pa.Array, letters: pa.Array) -> pa.Array:
        m = shared.value
        raw = texts.cast(pa.binary()).to_pylist()
        lang: list[str] = [UNDETERMINED] * len(raw)
        score, words = [0.0] * len(raw), [pa.scalar([], pa.list_(pa.string())).as_py() for _ in raw]
        has = letters.to_pylist()
        if m.languages:
            names = np.array(m.languages, object)
            for i, p in label_texts(m, [t if h else None for t, h in zip(raw, has)]):
                mean = p.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                lang[i], score[i] = m.languages[best], min(1.0, float(mean[best]))
                if with_words:
                    words[i] = names[p.argmax(axis=1)].tolist()
        return pa.StructArray.from_arrays(
            [pa.array(lang), pa.array(score), pa.array(words, pa.list_(pa.string()))], ["lang", "score", "word_langs"]
        )

    with_words = name != "_doc"
    text = F.col(text_col)
    return docs.withColumn(name, find(text, F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))))


def fit_from(docs: DataFrame, most: int = SAMPLE_ROWS, each: int = EACH_LANGUAGE, languages: int = LANGUAGES) -> Crf:
    """A model from at most ``most`` rows that have a language and are not held out, and ``each`` rows of every language.

    At most ``languages`` languages get rows of their own, so sample and model are bounded.
    """
    known = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang")
    return fit(labelled_sample(docs.where(~held_out(F.col("doc_id"))), known, "lang", most, each, languages))


def predict_languages(docs: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Without labelled rows everything is ``und``."""
    found = with_languages(docs.select("doc_id", "text"), fit_from(docs, most), name="_doc")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_doc.lang").alias("lang_pred"), F.col("_doc.score").alias("score")
    )
