"""Words of a text as 64-bit hashes, inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_WORDS = 1 << 19     # words remembered per worker


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing step (new array)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
    return h ^ (h >> np.uint64(29))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = mix(words[:size], 1)
    for k in range(1, n):
        h = mix(h + words[k:k + size], k + 1)
    return h
