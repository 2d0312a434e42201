"""Quality rules whose cutoffs come from labelled rows with exact bounds on false rejection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealcast.llm.common import bound_batches, unused_name
from arealcast.session import materialize

#: Cutoff by stratum and name of the rule; None: the rule rejects nothing there.
Cutoffs = dict[tuple[int, str], float | None]

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
GRAM = 5
_KIND = np.zeros(256, np.uint8)  # 1: first byte of a code point in a word; 3: that, and a symbol
_KIND[[b for b in range(256) if b & 0xC0 != 0x80 and b not in b" \t\n\r\x0b\x0c"]] = 1
_KIND[list(SYMBOLS)] = 3


def repeated_words(words: Sequence[bytes], gram: int = GRAM) -> int:
    """Words that lie in a window of ``gram`` words found at least twice; the first of them counts too."""
    n = len(words) - gram + 1
    if n < 2:
        return 0
    word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = word[:n].copy()
    for k in range(1, gram):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
        window += word[k : k + n]
    ordered = np.sort(window)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(window, again))
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + gram, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4)
    lines, seen, again = 0, set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), int(kinds[1] + kinds[3]), int(kinds[3]), again, repeated_words(words), lines


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))
def text_metrics(texts: pa.Array) -> pa.Array:
    rows = [measure(x or b"") for x in texts.cast(pa.binary()).to_pylist()]
    columns = list(zip(*rows)) or [()] * len(METRICS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], METRICS)


def base_failed(m: Column) -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


@dataclass(frozen=True)
class Rule:
    """A document fails where ``score`` is above the cutoff. ``grid``: cutoffs from the most lenient on, fixed in advance."""

    name: str
    grid: tuple[float, ...]

    def score(self, m: Column) -> Column:
        def ratio(a: str, b: str) -> Column:
            return F.coalesce(F.try_divide(m[a], m[b]), F.lit(0.0))

        return {
            "symbols": lambda: ratio("n_symbols", "word_chars"),
            "dup_lines": lambda: ratio("n_dup_lines", "n_lines"),
            "repeats": lambda: ratio("n_repeat_words", "n_words"),
            "long_words": lambda: ratio("word_chars", "n_words"),
            "short_words": lambda: -F.coalesce(F.try_divide(m["word_chars"], m["n_words"]), F.lit(0.0)),
        }[self.name]()


def steps(start: float, stop: float, n: int) -> tuple[float, ...]:
    return tuple(round(start + (stop - start) * k / n, 6) for k in range(n + 1))


RULES = (
    Rule("symbols", steps(0.5, 0.05, 18)),
    Rule("dup_lines", steps(0.9, 0.4, 10)),
    Rule("repeats", steps(0.2, 0.1, 10)),
    Rule("long_words", steps(40.0, 15.0, 10)),
    Rule("short_words", steps(-1.0, -2.5, 6)),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p): the exact p-value against a rejection rate of ``p`` or more."""
    if n == 0 or k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoffs(
    counts: dict[tuple[int, str], tuple[int, list[int]]], rules: Sequence[Rule], alpha: float, delta: float
) -> Cutoffs:
    """The strictest cutoff of each stratum and rule whose false rejection is shown to be below ``alpha / len(rules)``.

    ``counts``: good holdout rows of the stratum, and how many of them each cutoff of the grid rejects. What all rules
    reject together is at most the sum of what each rejects, so a rule may have its share of ``alpha`` only. Every stratum
    and rule gets the share ``delta / len(counts)`` of the error probability (Bonferroni), so that with probability
    ``1 - delta`` the verdict of all rules rejects less than ``alpha`` of the good rows of every stratum. Within a grid the cutoffs are tested in
    order and the first failure ends it (fixed-sequence testing), which needs no further correction. Where not even the
    first passes there is no cutoff, and the rule rejects nothing.
    """
    level = delta / max(1, len(counts))
    chosen: Cutoffs = {}
    for (stratum, name), (n, rejected) in counts.items():
        chosen[stratum, name] = None
        for cutoff, k in zip(next(r.grid for r in rules if r.name == name), rejected):
            if binomial_tail(k, n, alpha / len(rules)) > level:
                break
            chosen[stratum, name] = cutoff
    return chosen


#: Strata by number of words and language, bounded in number whatever the data are and known before any label is seen:
#: languages are dealt over so many groups by hash, those of a group are judged together.
BANDS, GROUPS = (200,), 16


def stratum(m: Column, group: Column, bounds: Sequence[int] = BANDS) -> Column:
    band = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        band = F.when(m["n_words"] < bounds[k], k).otherwise(band)
    return (band * GROUPS + group).cast("int")


def group_of(docs: DataFrame, lang_col: str = "lang") -> Column:
    """Group of a row's language; null is a language, and so is what tables without that column hold."""
    if lang_col not in docs.columns:
        return F.lit(0)
    return F.pmod(F.xxhash64(F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), F.lit(GROUPS)).cast("int")


ALPHA, DELTA = 0.03, 0.1


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, language group ``g`` and metrics ``m`` of every row, written to the shared folder: the texts are read once for all that follows."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), group_of(docs).alias("g"), text_metrics(text_col).alias("m")), "quality")


def calibrate(
    rows: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA
) -> Cutoffs:
    """Cutoffs from the rows (doc_id, g, m) that ``labels`` (doc_id, quality) marks as good and the base rules keep.

    Labels serve only to choose cutoffs and nothing is fitted on them, so all labelled rows are holdout. Every one is
    counted, in one aggregation of counters; the driver gets one row per stratum. Labels that repeat count once.
    """
    m = F.col("m")
    good = labels.where("quality = 1").select("doc_id").distinct()
    names = [(r, i, f"{r.name}_{i}") for r in rules for i in range(len(r.grid))]
    found = (
        rows.join(good, "doc_id", "left_semi")
        .where(~base_failed(m))
        .groupBy(stratum(m, F.col("g")).alias("stratum"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r.score(m) > r.grid[i]).alias(n) for r, i, n in names])
        .collect()
    )
    counts = {
        (row.stratum, r.name): (row.n, [row[f"{r.name}_{i}"] for i in range(len(r.grid))]) for row in found for r in rules
    }
    return choose_cutoffs(counts, rules, alpha, delta)


def verdict(cutoffs: Cutoffs, m: Column, group: Column, rules: Sequence[Rule] = RULES) -> Column:
    """True where the base rules keep the row and no rule's cutoff for its stratum is passed."""
    keep = ~base_failed(m)
    for rule in rules:
        known = {s: c for (s, name), c in cutoffs.items() if name == rule.name and c is not None}
        if known:
            cutoff = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])[stratum(m, group)]
            keep = keep & ~F.coalesce(rule.score(m) > cutoff, F.lit(False))
    return keep


def score_quality(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """One row per document: doc_id, the metrics, base_failed and kept.

    Null and empty texts have no words and fail the base rules. Without labels every document that passes the base rules
    stays. Labels of unknown or null ids count nothing. An id that repeats is measured row by row.
    """
    rows, m = measured(docs), F.col("m")
    keep = verdict(calibrate(rows, labels, **risk), m, F.col("g"))
    return rows.select("doc_id", *[m[n].alias(n) for n in METRICS], base_failed(m).alias("base_failed"), keep.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are never shuffled: they are measured once for the cutoffs and again where they are filtered.
    """
    bound_batches(docs.sparkSession)
    cutoffs = calibrate(measured(docs), labels, **risk)
    name = unused_name(docs, "m")
    judged = docs.withColumn(name, text_metrics("text"))
    return judged.where(verdict(cutoffs, F.col(name), group_of(docs))).drop(name)
