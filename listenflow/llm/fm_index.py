"""FM-index over word sequences: a bounded-depth BWT held in a wavelet matrix.

``FMIndex`` indexes a sequence of symbols, sorted by the first ``depth``
symbols of every suffix (patterns of up to ``depth`` symbols can be searched).
Bit vectors are packed with a count per 64-bit word.  All searches are
vectorised: many patterns go backwards through the index in step.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = -(-len(bits) // 64) + 1
        self.words = np.zeros(words, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(words, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first ``i`` bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        self.depth = max(1, int(size - 1).bit_length())
        s = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (s >> level) & 1
            ones = bits.astype(bool)
            self.levels.append((level, Bits(ones), int(len(s) - ones.sum())))
            s = np.concatenate([s[~ones], s[ones]])
        self.start = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where((c >> level) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` in the first ``i`` symbols."""
        return self._walk(c, i) - self.start[c]


class FMIndex:
    """Index of ``text``: symbols 1.. with 0 as separator (never searched)."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        self.depth = depth
        rank, have = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            key = rank * (n + 1)
            key[:n - have] += rank[have:] + 1 if have < n else 0
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1])]))
            have *= 2
        self.suffixes = order
        self.wavelet = WaveletMatrix(text[order - 1], size)     # the symbol before each suffix
        self.smaller = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=self.smaller[1:])

    def matching_statistics(self, text: np.ndarray, at: np.ndarray, length: int
                            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the position that ends each window ``text[at : at + length]``, the
        length (up to ``length``) of the longest match that ends there and also
        elsewhere in the index, and the suffix range of the window.

        A range that has shrunk to one suffix is the window's own: the match
        ends there and is not followed further.
        """
        c = text[at + length - 1]
        lo, hi = self.smaller[c], self.smaller[c + 1]
        live = np.flatnonzero(hi - lo > 1)
        matched = np.zeros(len(at), np.int64)
        matched[live] = 1
        for k in range(length - 2, -1, -1):
            if not len(live):
                break
            c = text[at[live] + k]
            base = self.smaller[c]
            lo[live] = base + self.wavelet.rank(c, lo[live])
            hi[live] = base + self.wavelet.rank(c, hi[live])
            live = live[hi[live] - lo[live] > 1]
            matched[live] += 1
        return matched, lo, hi


def range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of ``values[lo:hi]`` for ranges that are equal or disjoint."""
    first, back = np.unique(lo, return_inverse=True)
    end = np.empty(len(first), np.int64)
    end[back] = hi
    cuts = np.column_stack([first, end]).ravel()
    padded = np.append(values, values[-1:])
    return np.minimum.reduceat(padded, cuts)[::2][back]
