"""Sets of hashed word shingles of a text, as sorted numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_MAX_WORDS = 150_000  # of the cache of word hashes; it starts anew when full
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words.

    Words lie between ASCII white space, A-Z are lowered.  A text of fewer words is one
    shingle; without any word the set is empty.
    """
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        whole = xxhash.xxh3_64_intdigest(b" ".join(found), seed=words)
        return np.array([whole], np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    count = len(found) - words + 1
    run = each[:count].copy()
    for i in range(1, words):
        run *= _FACTOR
        run ^= run >> _SHIFT
        run += each[i : i + count]
    run ^= run >> _SHIFT
    run *= _MIX
    run ^= run >> _SHIFT
    return np.unique(run)
