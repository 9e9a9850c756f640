"""Words, runs of words and their hashes, over whole Arrow batches at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_CACHE_WORDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, start: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """``n`` fixed, well-spread 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(start))


class Hasher:
    """Hashes words to 64 bits and keeps the hashes of the words it has seen, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        out = np.empty(len(words), dtype=_U)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive word hashes (those that cross texts are the caller's to leave out)."""
    if len(hashes) < k:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        at = np.zeros(len(hashes) - k + 1, dtype=_U)
        for i, s in enumerate(seeds(k, 0xD1342543DE82EF95)):
            at += hashes[i : len(hashes) - k + 1 + i] * (s | _U(1))
        return mix(at)


def segment_minima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least value of each non-empty half-open segment."""
    at = np.empty(2 * len(starts), dtype=np.int64)
    at[0::2], at[1::2] = starts, ends
    return np.minimum.reduceat(np.append(values, _U(0xFFFFFFFFFFFFFFFF)), at)[0::2]

