"""64-bit hashes of words and of runs of words, vectorised per document."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: An odd base, its inverse modulo 2**64, and the constants of a 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Words that a worker keeps with their hashes; beyond that it starts anew.
REMEMBERED = 120_000


class WordHashes(dict):
    """Hash of a word, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1024, 1 << n.bit_length())
        known = np.full(size, base % 2**64, U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 21:
            _POWERS[base] = known
    return known[:n]


class Runs:
    """Hashes of any run of words ``[start, end)`` of one document from prefix sums of ``hash * BASE**place``."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(hashes * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])
