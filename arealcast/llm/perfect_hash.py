"""Minimal perfect hashes over byte strings, in shards, with the keys stored for verification.

A shard is built in levels: every key is hashed into a bit array; places hit by one key are set, the other keys go to the
next level. The rank of a key's set bit, over all levels, is its slot; n keys fill the slots 0 to n - 1. A string that is
no key may reach a slot too, so a lookup compares the key stored there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

GAMMA = 2  # bits a key and level
LEVELS = 48  # so many levels leave a key over about once in 2 ** 40 shards; that raises an error
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
SEED = 42  # of Spark's xxhash64, so that shards can be dealt out there


def key_hashes(keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
    return first, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    """As ``pmod(xxhash64(key), shards)``."""
    return first.view(np.int64) % np.int64(shards)


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits) -> np.ndarray:
    h = (h1 + h2 * np.uint64(2 * level + 1)) * _MIX
    h = (h ^ (h >> np.uint64(31))) * _MIX2
    return ((h ^ (h >> np.uint64(29))) % np.asarray(bits, np.uint64)).astype(np.int64)


def build(keys: list[bytes]) -> tuple[list[int], bytes, list[bytes]]:
    """Bits of each level, the bit arrays one behind the other, and the keys in order of their slots. Keys are distinct."""
    h1, h2 = key_hashes(keys)
    left = np.arange(len(keys))
    sizes, words, order = [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        bits = -(-GAMMA * len(left) // 64) * 64
        at = _place(h1[left], h2[left], level, bits)
        alone = np.bincount(at, minlength=bits) == 1
        placed = alone[at]
        order.append(left[placed][np.argsort(at[placed])])
        sizes.append(bits)
        words.append(np.packbits(alone, bitorder="little"))
        left = left[~placed]
    if len(left):
        raise RuntimeError("keys with equal hashes")
    slots = np.concatenate(order) if order else np.zeros(0, np.int64)
    return sizes, b"".join(w.tobytes() for w in words), [keys[i] for i in slots.tolist()]


@dataclass
class PerfectHash:
    """Shards in order; the slots of a shard follow those of the shards before it."""

    start: np.ndarray  # (shards, levels): first bit
    size: np.ndarray  # (shards, levels): number of bits, 0 where the shard has no such level
    words: np.ndarray
    rank: np.ndarray  # set bits before each word
    keys: pa.Array

    @classmethod
    def of(cls, shards: Sequence[tuple[list[int], bytes, list[bytes]]]) -> PerfectHash:
        levels = max([1, *(len(s[0]) for s in shards)])
        size = np.zeros((len(shards), levels), np.int64)
        for i, s in enumerate(shards):
            size[i, : len(s[0])] = s[0]
        start = np.concatenate(([0], np.cumsum(size.ravel())[:-1])).reshape(size.shape)
        words = np.frombuffer(b"".join(s[1] for s in shards) or bytes(8), "<u8").astype(np.uint64)
        rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
        return cls(start, size, words, rank, pa.array([k for s in shards for k in s[2]], pa.large_binary()))

    def slots(self, terms: Sequence[bytes]) -> np.ndarray:
        """Slot of every term, -1 for those that are no key."""
        h1, h2 = key_hashes(terms)
        shard = shard_of(h1, len(self.start))
        out = np.full(len(terms), -1, np.int64)
        open_ = np.arange(len(terms))
        for level in range(self.size.shape[1]):
            bits = self.size[shard[open_], level]
            open_, bits = open_[bits > 0], bits[bits > 0]
            if not len(open_):
                break
            at = self.start[shard[open_], level] + _place(h1[open_], h2[open_], level, bits)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[held]] & ((np.uint64(1) << bit[held]) - np.uint64(1))
            out[open_[held]] = self.rank[word[held]] + np.bitwise_count(below)
            open_ = open_[~held]
        found = np.flatnonzero(out >= 0)
        if len(found):
            stored = self.keys.take(pa.array(out[found]))
            asked = pa.array([terms[i] for i in found.tolist()], pa.large_binary())
            out[found[~pc.equal(stored, asked).to_numpy(zero_copy_only=False)]] = -1
        return out
