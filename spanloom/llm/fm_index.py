"""FM-index over word numbers: suffix array, wavelet matrix, backward search of many phrases, sampled locating."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of non-negative numbers, by prefix doubling; a shorter suffix comes first."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(False, np.diff(key[order]) > 0))
        if n == 0 or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2


class Bits:
    """A bit vector with rank by 64-bit words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Rank of any symbol below `sigma` before any position."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = (text >> level) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(len(one) - int(one.sum()))
            text = np.concatenate([text[~one], text[one]])
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank before it."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


class FmIndex:
    """Of numbers from 1 to sigma - 1; 0 is the end mark, which the index adds."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        sampled = order % sample == 0
        self.marked, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, filled with 0 on the left) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, j] > 0) & (low < high))
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a row whose position is sampled."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, now = np.arange(len(rows)), rows
        while len(left):
            hit = self.marked.get(now)
            out[left[hit]] = self.positions[self.marked.rank(now[hit])] + steps
            left, now = left[~hit], now[~hit]
            symbol, rank = self.wavelet.access(now)
            now = self.before[symbol] + rank
            steps += 1
        return out
