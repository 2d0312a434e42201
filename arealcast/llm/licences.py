"""Licence scan over a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealcast.llm.common import alnum_words


@dataclass(frozen=True)
class Template:
    """``text``: words of a notice. ``key``: place and number of the words that have to stand there exactly.

    ``share``: least share of the notice's weight (inverse document frequencies) whose words stand in their places.
    """

    label: str
    text: str
    share: float = 1.0
    key: tuple[int, int] = (0, 0)
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


def _keyed(label: str, text: str, phrase: str, share: float = 0.7) -> Template:
    words, part = text.split(), phrase.split()
    at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return Template(label, text, share, (at, len(part)))


#: Phrases fixed by the query's contract; all words have to stand in their places.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
#: Openings of common notices, found also where some words differ.
NOTICES = (
    _keyed("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    _keyed("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache license version 2"),
    _keyed("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    _keyed("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3", 0.5),
    _keyed("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2", 0.5),
    _keyed("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", 0.5),
    _keyed("agpl-3", "this work is licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", 0.5),
    _keyed("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution and use in source and binary forms"),
    _keyed("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    _keyed("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", 0.6),
    _keyed("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    _keyed("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.6),
    _keyed("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    _keyed("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    _keyed("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def document_frequencies(words: DataFrame, templates: Sequence[Template]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the templates. One row per such word reaches the driver."""
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    n = words.count()
    held = words.select(F.explode(F.array_intersect("words", vocab)).alias("w")).groupBy("w").count()
    return n, {r.w: r["count"] for r in held.collect()}


def idf(n: int, df: dict[str, int], word: str) -> float:
    return round(math.log((n + 1) / (df.get(word, 0) + 0.5)), 6)


def _starts(words: Column, word: str, place: int) -> Column:
    """Where a template would begin that has ``word`` at ``place``, for every occurrence of the word."""
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i) == word)
    return F.transform(at, lambda i: i - 1 - place)


def _agreeing(words: Column, start: Column, expected: Column, weights: Column, k: Column) -> Column:
    """Weight of the template's word ``k`` if the text has it in its place, else 0; the text may end before or after."""
    at = start + k
    return F.when((at >= 0) & (F.get(words, at) == F.get(expected, k)), F.get(weights, k)).otherwise(0.0)


def _labelled(places: Column, t: Template) -> Column:
    return F.transform(
        places,
        lambda x: F.struct(
            F.lit(t.label).alias("label"), x["at"].alias("at"), x["score"].alias("score"), F.lit(t.base).alias("base")
        ),
    )


def _matches(words: Column, present: Column, t: Template, n: int, df: dict[str, int], lookups: int) -> Column:
    """ARRAY<STRUCT<at, score>>: places where the template begins.

    The index of a template lists its words with their places, rarest first. Of those that the text holds, the
    ``lookups`` rarest are looked up; every occurrence gives the place where the template would begin, and there all its
    words are compared with the text by relative position. A text in which the words it lacks weigh too much to reach
    ``share`` is not looked at further, which loses nothing.
    """
    weight = {w: max(0.0, idf(n, df, w)) + 1e-3 for w in t.words}
    total = round(sum(weight[w] for w in t.words), 6)
    rare = sorted(set(t.words), key=lambda w: (-weight[w], w))
    postings = [(w, [i for i, x in enumerate(t.words) if x == w]) for w in rare]
    need = round(t.share * total, 6) - 1e-6
    held = [F.when(F.array_contains(present, w), round(weight[w] * len(p), 6)).otherwise(0.0) for w, p in postings]
    possible = sum(held[1:], held[0]) >= need
    none = F.array().cast("array<struct<at:int,score:double>>")

    # A place of the template is missed only if all the words looked up are changed there. So many are looked up that
    # the rest could not reach the share alone.
    looked, rest = [], total
    for w, p in postings:
        looked.append((w, p))
        rest -= weight[w] * len(p)
        if rest < need and len(looked) >= min(lookups, len(postings)):
            break
    if t.share >= 1:  # every word has to be there, so the rarest alone is enough
        looked = [(postings[0][0], postings[0][1][:1])]
    starts = F.flatten(F.array(*[_starts(words, w, k) for w, p in looked for k in p]))
    inside = F.filter(F.array_distinct(starts), lambda s: s + len(t.words) > 0)

    a, m = t.key if not t.base else (0, len(t.words))
    expected, weights = F.array(*map(F.lit, t.words)), F.array(*[F.lit(weight[w]) for w in t.words])

    def scored(s: Column) -> Column:
        here = F.transform(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), lambda k: _agreeing(words, s, expected, weights, k))
        sum_ = F.aggregate(here, F.lit(0.0), lambda x, y: x + y)
        return F.struct(s.alias("at"), F.round(sum_ / total, 6).alias("score"))

    def key_holds(s: Column) -> Column:
        return F.coalesce(F.array_join(F.slice(words, s + a + 1, F.lit(m)), " ") == " ".join(t.words[a : a + m]), F.lit(False))

    verified = F.filter(inside, lambda s: (s + a >= 0) & key_holds(s))
    places = F.filter(F.transform(verified, scored), lambda x: x["score"] >= (0.999999 if t.share >= 1 else t.share))
    return F.when(possible, places).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lookups: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches``: ARRAY<STRUCT<label, at, score, base>> of all places found. ``score`` is that of the best. Null and
    empty texts have no words and no labels; label strings are then empty. Everything is worked out inside the row; only
    the document frequencies of the templates' words are gathered, over all documents.
    """
    templates = [*BASE, *NOTICES]
    split = docs.select(F.col(id_col).alias("doc_id"), alnum_words(F.col(text_col)).alias("words"))
    n, df = document_frequencies(split, templates)
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    rows = split.select("doc_id", "words", F.array_intersect("words", vocab).alias("present"))
    found = [_labelled(_matches(F.col("words"), F.col("present"), t, n, df, lookups), t) for t in templates]
    out = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*found)).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    at = F.transform(base, lambda m: m["at"].cast("long"))

    def joined(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        "matches",
    )
