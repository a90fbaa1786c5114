"""An FM-index over whole numbers, in numpy: counts and places of many patterns at once."""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix position is kept.
SAMPLE_EVERY = 16


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of the suffixes in order. The last symbol must be the only 0.

    A first sort by as many symbols as fit in one word, then prefix doubling over those suffixes
    only that are still tied, so long repeats cost a few more rounds on their own rows.
    """
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.ones(n, bool)  # rows that begin a group of tied suffixes
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        at = order[rows]
        after = at + depth
        then = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + then
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[rows] = at
        first = np.ones(len(rows), bool)
        np.not_equal(pair[1:], pair[:-1], out=first[1:])
        head[rows] = first
        rank[at] = np.maximum.accumulate(np.where(first, rows, 0))
        depth *= 2


class BitRank:
    """Bits with ranks: a packed word array and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """A wavelet tree laid out level by level (a wavelet matrix)."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        for level in range(self.depth - 1, -1, -1):
            bit = (text >> level) & 1 != 0
            self.levels.append(BitRank(bit))
            left = text[~bit]
            self.zeros.append(len(left))
            text = np.concatenate([left, text[bit]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.depth - 1 - k)) & 1 != 0
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbol, i) - self.first[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


class FMIndex:
    """Index of one text of symbols 1 to ``symbols - 1``; 0 is put at its end."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text, symbols)
        self.tree = WaveletTree(text[order - 1], symbols)  # the symbol before each suffix
        counts = np.bincount(text, minlength=symbols)
        self.below = np.cumsum(counts) - counts
        self.counts = counts
        kept = order % every == 0
        self.kept = BitRank(kept)
        self.places = order[kept]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (rows of a matrix, aligned to its right edge), by backward search."""
        width = patterns.shape[1]
        low, high = np.zeros((2, len(patterns)), np.int64)
        symbol = patterns[:, -1]
        low[:], high[:] = self.below[symbol], self.below[symbol] + self.counts[symbol]
        alive = np.flatnonzero(low < high)
        for k in range(2, width + 1):
            alive = alive[(lengths[alive] >= k) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - k]
            both = self.tree.rank(np.tile(symbol, 2), np.concatenate([low[alive], high[alive]]))
            both += np.tile(self.below[symbol], 2)
            low[alive], high[alive] = np.split(both, 2)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a kept one, count the steps."""
        rows = rows.copy()
        out = np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        steps = 0
        while len(left):
            at = rows[left]
            kept = self.kept.get(at)
            done = left[kept]
            out[done] = self.places[self.kept.ones(at[kept])] + steps
            left = left[~kept]
            symbol, rank = self.tree.symbol_and_rank(at[~kept])
            rows[left] = self.below[symbol] + rank
            steps += 1
        return out
