"""Token counts of byte-pair encoding by heap and linked list."""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-tokeniser's pattern of byte-level vocabularies and the characters that it counts as space.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose counts a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Ranks of the merges of one vocabulary file.

    Symbols are small integers used only inside: bytes first, then the distinct strings that merges make.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = {c: b for b, c in byte_letters().items()}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = symbol.setdefault(left + right, len(symbol))
            self.rank.setdefault(symbol[left] << 32 | symbol[right], len(self.made))
            self.made.append(made)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges; the pair of the lowest rank, leftmost first, is merged until none is left."""
        symbols = list(word)
        n = left = len(symbols)
        if n < 2:
            return n
        rank, made, missing = self.rank, self.made, 1 << 62
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            r << 32 | i
            for i in range(n - 1)
            if (r := rank.get(symbols[i] << 32 | symbols[i + 1], missing)) != missing
        ]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            # Entries whose pair has changed since are stale.
            if symbols[i] < 0 or j >= n or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = made[r], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, s << 32 | i)
            if (h := before[i]) >= 0 and (s := rank.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, s << 32 | h)
        return left


class Counter(dict):
    """Tokens of a run of white space and the word behind it; the pre-tokeniser never joins a word to what follows."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self.pieces = regex.compile(PIECES)
        self.units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = sum(self.merges.count(p.encode()) for p in self.pieces.findall(unit))
        if len(unit) <= 64:
            self[unit] = n
        return n

    def tokens(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        if not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, self.special.split(text)))

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units.findall(text)))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the byte-level BPE file at ``path``, without begin, end or added special tokens.

    A special token's string inside a text counts as that one token. Null and empty texts have none. ``path`` is read
    on the executors, so the file must lie at the same place on each, as an installed package does.
    """

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        tokens = counter(path).tokens
        return pa.array([tokens(x) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias(id_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(F.col(text_col), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
