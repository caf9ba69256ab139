"""Shingle sets of texts as sorted 64-bit hashes (runs inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MOST_WORDS = 50_000
LONGEST_WORD = 48


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS and len(word) <= LONGEST_WORD:
            self[word] = h
        return h


_HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix64 generator: spreads every bit over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text.

    A-Z count as a-z; words are what white space (U+0020, U+0009 to U+000D)
    separates.  A text with fewer words is one shingle, without words none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):  # an odd multiplier for each place
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix(h[i:len(h) - k + 1 + i])
    return np.unique(mix(total))


def set_keys(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent hashes of a whole set: a signed one of ``bits`` bits and a signed one of 64."""
    both = (xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) >> (64 - bits), xxhash.xxh3_64_intdigest(s.tobytes(), ~len(s) & (2**64 - 1)))
    return tuple(int(np.int64(np.uint64(h))) for h in both)


def set_key(s: np.ndarray, twins: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """The class of a set: its first hash, or its second where the first is one of ``twins``, which different sets share."""
    first, second = set_keys(s, bits)
    return second if first in twins else first
