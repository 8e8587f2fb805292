"""Minimal perfect hashes over the terms of one shard, with the terms stored for verification.

Every level is a bit array about twice as long as the keys left: a key that has a place of
its own there sets its bit, the others go on to the next level. The rank of a key's bit
among all bits of all levels is its slot, so slots are dense.
"""

from __future__ import annotations

import numpy as np

from pathledger.llm.text import mix, span_hashes

_tables: dict[int, np.ndarray] = {}


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    if seed not in _tables:
        draws = np.random.default_rng([77, seed]).integers(1 << 63, size=256, dtype=np.uint64)
        _tables[seed] = draws * np.uint64(2) + np.uint64(1)
    return span_hashes(_tables[seed][data], starts, ends)


def same_bytes(data, starts, ends, other, other_starts, other_ends) -> np.ndarray:
    """Whether each span of ``data`` equals the span of ``other`` beside it, byte by byte."""
    lengths = ends - starts
    same = lengths == other_ends - other_starts
    at = np.flatnonzero(same & (lengths > 0))
    if len(at):
        n = lengths[at]
        cuts = np.concatenate([[0], np.cumsum(n)[:-1]])
        step = np.arange(int(n.sum())) - np.repeat(cuts, n)
        differs = data[step + np.repeat(starts[at], n)] != other[step + np.repeat(other_starts[at], n)]
        same[at] = ~np.logical_or.reduceat(differs, cuts)
    return same


class PerfectHash:
    """Slots 0..n-1 of n distinct 64-bit hashes."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mix(hashes ^ salt) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash | None:
        """None if two hashes are equal."""
        if len(np.unique(hashes)) < len(hashes):
            return None
        sizes, words, level = [], [np.zeros(0, np.uint64)], 0
        while len(hashes):
            size = max(64, -(-2 * len(hashes) // 64) * 64)
            places = cls._places(hashes, level, size)
            alone = np.bincount(places, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            hashes = hashes[~alone[places]]
            level += 1
        return cls(sizes, np.concatenate(words))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for what is no key."""
        out = np.full(len(hashes), -1, np.int64)
        left, offset = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            places = self._places(hashes[left], level, size) + offset
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self._before[word] + np.bitwise_count(below)
            out[left[found]] = rank[found]
            left = left[~found]
            offset += size
        return out


class TermShard:
    """A perfect hash of terms and the terms themselves in the order of their slots."""

    def __init__(self, seed: int, sizes: list[int], words: bytes, terms: bytes, ends: bytes):
        self.seed = seed
        self.hash = PerfectHash(list(sizes), np.frombuffer(words, np.uint64))
        self.terms = np.frombuffer(terms, np.uint8)
        self.ends = np.frombuffer(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])

    @staticmethod
    def build(terms: list[bytes]) -> dict:
        """Columns of a shard; another seed in the event of equal hashes."""
        def spans(parts):
            ends = np.cumsum([len(t) for t in parts], dtype=np.int64)
            return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]), ends

        data, starts, ends = spans(terms)
        seed = 0
        while (built := PerfectHash.build(hashes := term_hashes(data, starts, ends, seed))) is None:
            seed += 1
        order = np.argsort(built.slots(hashes))
        placed, _, ends = spans([terms[i] for i in order])
        return {
            "seed": seed, "sizes": built.sizes, "words": built.words.tobytes(),
            "terms": placed.tobytes(), "ends": ends.tobytes(),
        }

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each span of ``data`` with its hash of seed 0; -1 for those that are no stored term."""
        slots = self.hash.slots(hashes if self.seed == 0 else term_hashes(data, starts, ends, self.seed))
        at = np.flatnonzero(slots >= 0)
        hit = slots[at]
        sure = same_bytes(data, starts[at], ends[at], self.terms, self.starts[hit], self.ends[hit])
        slots[at[~sure]] = -1
        return slots
