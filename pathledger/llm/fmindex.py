"""A compressed FM-index over token sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols as one bit vector per binary digit, with ranks by words of 64 bits."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits = digits
        self.n = len(symbols)
        self.words, self.ranks, self.zeros = [], [], []
        for digit in range(digits - 1, -1, -1):
            bit = (symbols >> digit & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(self.n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` comes to lie in the order of the last level, followed by ``symbol``'s digits."""
        for level in range(self.digits):
            one = (symbol >> (self.digits - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index of sequences for matches of at most ``longest`` tokens.

    Suffixes are sorted by prefix doubling up to the first power of two that covers
    ``longest`` + 1, which is all that a search of such patterns can tell apart.
    """

    def __init__(self, tokens: np.ndarray, begins: np.ndarray, longest: int):
        """tokens of all sequences behind one another; begins: where each begins, and the end."""
        self.longest = longest
        count = len(begins) - 1
        self.alphabet, symbol = np.unique(tokens, return_inverse=True)
        n = len(tokens) + count
        # A separator, symbol 0, follows each sequence.
        self.begins = begins + np.arange(count + 1)
        text = np.zeros(n, np.int64)
        text[np.arange(len(tokens)) + np.repeat(np.arange(count), np.diff(begins))] = symbol + 1
        self.text = text
        self.ranks = {1: text}
        size = 1
        while size <= longest:
            rank = self.ranks[size]
            after = np.zeros(n, np.int64)
            after[: n - size] = rank[size:]
            self.ranks[2 * size] = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1]
            size *= 2
        self.order = np.argsort(self.ranks[size], kind="stable")
        before = text[self.order - 1]
        before[self.order == 0] = 0
        digits = max(1, int(len(self.alphabet)).bit_length())
        self.last = WaveletMatrix(before, digits)
        symbols = np.arange(len(self.alphabet) + 1)
        counts = np.bincount(text, minlength=len(symbols))
        self.first = np.cumsum(counts) - counts
        self.base = self.last.place(symbols, np.zeros(len(symbols), np.int64))
        self._shared = self._common()
        self._cuts: dict[int, np.ndarray] = {}
        starts = self._boundaries(longest)
        self.classes = np.searchsorted(starts, np.arange(n), "right") - 1
        self.class_starts = np.append(starts, n)

    def _common(self) -> np.ndarray:
        """Tokens that each suffix shares with the one before it in order, up to the sorted length."""
        shared = np.zeros(len(self.order), np.int64)
        a, b = self.order[:-1], self.order[1:]
        got = np.zeros(len(a), np.int64)
        for size in sorted(self.ranks, reverse=True)[1:]:
            i, j = a + got, b + got
            ok = (i < len(self.text)) & (j < len(self.text))
            rank = self.ranks[size]
            same = ok & (rank[np.where(ok, i, 0)] == rank[np.where(ok, j, 0)])
            got += size * same
        shared[1:] = got
        return shared

    def _boundaries(self, length: int) -> np.ndarray:
        """First places of the ranges of suffixes that agree on ``length`` tokens."""
        if length not in self._cuts:
            self._cuts[length] = np.flatnonzero(self._shared < length)
        return self._cuts[length]

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        """Symbols of tokens, -1 for those not in the index."""
        if not len(self.alphabet):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.alphabet, tokens), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == tokens, at + 1, -1)

    def _extend(self, symbol, low, high):
        """Ranges of the patterns with one symbol put before them."""
        known = symbol > 0
        s = np.where(known, symbol, 0)
        shift = self.first[s] - self.base[s]
        lo, hi = self.last.place(s, low) + shift, self.last.place(s, high) + shift
        return np.where(known, lo, 0), np.where(known, hi, 0)

    def matching_statistics(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every position of the sequences: the length of its longest match, ``longest`` at
        most, and the range of suffixes that start with it.

        All sequences are read from their ends at once; a step puts one symbol before each match.
        A match that can't be extended is shortened by the ranges that agree on less.
        """
        n = len(self.order)
        length, low, high = (np.zeros(len(symbols), np.int64) for _ in range(3))
        sizes = np.diff(begins)
        lanes = np.argsort(-sizes, kind="stable")
        ends, ordered = begins[1:][lanes], sizes[lanes]
        l = np.zeros(len(lanes), np.int64)
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), n)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            active = int(np.searchsorted(-ordered, -step, "right"))
            at = ends[:active] - step
            symbol = symbols[at]
            new_lo, new_hi = self._extend(symbol, lo[:active], hi[:active])
            stuck = np.flatnonzero((new_hi <= new_lo) & (l[:active] > 0))
            while len(stuck):
                l[stuck] -= 1
                for size in np.unique(l[stuck]):
                    own = stuck[l[stuck] == size]
                    if size == 0:
                        lo[own], hi[own] = 0, n
                    else:
                        cuts = np.append(self._boundaries(int(size)), n)
                        place = np.searchsorted(cuts, lo[own], "right") - 1
                        lo[own], hi[own] = cuts[place], cuts[place + 1]
                new_lo[stuck], new_hi[stuck] = self._extend(symbol[stuck], lo[stuck], hi[stuck])
                stuck = stuck[(new_hi[stuck] <= new_lo[stuck]) & (l[stuck] > 0)]
            found = new_hi > new_lo
            l[:active] = np.where(found, l[:active] + 1, 0)
            lo[:active] = np.where(found, new_lo, 0)
            hi[:active] = np.where(found, new_hi, n)
            over = np.flatnonzero(l[:active] >= self.longest)
            l[over] = self.longest
            own = self.classes[lo[over]]
            lo[over], hi[over] = self.class_starts[own], self.class_starts[own + 1]
            length[at], low[at], high[at] = l[:active], lo[:active], hi[:active]
        return length, low, high
