"""Words, word shingles and their 64-bit fingerprints, for whole texts.

Words are the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing ``A-Z``; everything else in a
text stays as it is, so any two engines that split UTF-8 text this way agree on the words.
"""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_CACHE_WORDS = 120_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hash of each word, remembered for frequent words up to a fixed number of entries."""

    def __init__(self, entries: int = _CACHE_WORDS):
        self.entries, self.known = entries, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.entries:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(word_hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Fingerprint of each run of ``width`` words; with fewer words, one fingerprint of the whole sequence."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _MULTIPLIER + word_hashes[i : n - k + 1 + i]
        return mix(h)


def shingle_set(text: str | None, hasher: WordHasher, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle fingerprints of a whole text."""
    return np.unique(rolling(hasher(words_of(text)), width))
