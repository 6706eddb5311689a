"""Word hashes and window hashes of texts, in numpy, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a Python worker keeps.
CACHE_SIZE = 150_000
_BASE = 0x9E3779B97F4A7C15 | 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_SIZE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def split(text: bytes, lower: bool) -> list[bytes]:
    """Words between ASCII white space; lower: A-Z in lower case."""
    return (text.lower() if lower else text).split()


def powers(k: int) -> np.ndarray:
    out = np.ones(k, np.uint64)
    for i in range(1, k):
        out[i] = out[i - 1] * np.uint64(_BASE)
    return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words: a polynomial, so that two windows side by side combine
    into one of twice the length (see join)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += words[j : j + n]
    return out


def join(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Hashes of windows whose halves have the hashes left and right; k: words in the right one."""
    return left * np.uint64(pow(_BASE, k, 1 << 64)) + right


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits, for places where parts of a hash are used."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
