"""Word-shingle sets of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Remembered

WORDS_PER_SHINGLE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no visible structure."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(Remembered):
    OPERATOR = "shingles"

    def made(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


#: One for each worker process, which its tasks share.
HASHES = WordHashes()


def shingle_set(text: bytes | None, hashes: WordHashes = HASHES) -> np.ndarray:
    """Distinct shingles of a UTF-8 text: A-Z lower-cased, words between ASCII white space. Fewer than five words are one shingle; none, no shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS_PER_SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS_PER_SHINGLE + 1
    rolled = w[:n] * _ODD[0]
    for k in range(1, WORDS_PER_SHINGLE):
        rolled += w[k : k + n] * _ODD[k]
    return np.unique(mix(rolled))
