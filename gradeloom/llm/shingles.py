"""Hashes of words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
#: Words whose hash a worker keeps before it starts over.
MAX_WORDS = 200_000
#: Odd multipliers, one for each place of a shingle, drawn by rule.
PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(WIDTH)], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_words = WordHashes()


def forget() -> None:
    _words.clear()



def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """A hash for each run of five words, in order; for fewer words one for the whole; for none nothing."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    if n < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    h = word_hashes(words)
    last = n - WIDTH + 1
    out = h[:last] * PLACES[0]
    for i in range(1, WIDTH):
        out += h[i : i + last] * PLACES[i]
    return mixed(out)


def distinct(words: list[bytes]) -> np.ndarray:
    """The set of a text's shingle hashes, ascending."""
    return np.unique(shingles(words))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
