"""A compressed FM-index over integer symbols: packed wavelet matrix, sampled counts, backward search.

All searches are done for many patterns at once, one symbol per step.
"""

from __future__ import annotations

import numpy as np

from .suffix import suffix_array

_ONE = np.uint64(1)
#: Patterns searched together, so that their intervals stay in cache.
BLOCK = 1 << 14


class Wavelet:
    """Wavelet matrix: one packed bit vector for each bit of the symbols, counts sampled every 64 places."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.bits = len(symbols), max(1, int(symbols.max()).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(int(self.n - ones.sum()))
            current = np.concatenate([current[~ones], current[ones]])
        # in ``current`` equal symbols stand together: where each begins
        self.begin = np.full(int(symbols.max()) + 1, 0, np.int64)
        at = np.flatnonzero(np.append(True, current[1:] != current[:-1]))
        self.begin[current[at]] = at

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        i = place.copy()
        for level in range(self.bits):
            block = i >> 6
            below = (_ONE << (i & 63).astype(np.uint64)) - _ONE
            ones = self.counts[level][block] + np.bitwise_count(self.words[level][block] & below)
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return i - self.begin[symbol]


class FMIndex:
    """Of a text whose last symbol is 0 and appears nowhere else."""

    def __init__(self, text: np.ndarray):
        self.text = text
        sa = suffix_array(text)
        self.wavelet = Wavelet(text[sa - 1])
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)

    def matching(self, ends: np.ndarray, most: int, occurrences: int = 2) -> np.ndarray:
        """For patterns that end before the places ``ends`` of the text: the length, up to ``most``, of the
        longest one that occurs ``occurrences`` times, by backward search."""
        out = np.zeros(len(ends), np.int64)
        for a in range(0, len(ends), BLOCK):
            end = ends[a : a + BLOCK]
            live = np.arange(len(end))
            low, high = np.zeros(len(end), np.int64), np.full(len(end), len(self.text), np.int64)
            for k in range(1, most + 1):
                symbol = self.text[end[live] - k]
                both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
                first = self.smaller[symbol]
                low, high = first + both[: len(live)], first + both[len(live) :]
                keep = high - low >= occurrences
                live, low, high = live[keep], low[keep], high[keep]
                if not len(live):
                    break
                out[a + live] = k
        return out
