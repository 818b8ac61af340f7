"""Words as runs of letters and digits, and their 64-bit hashes in flat arrays."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_ASCII = re.compile(r"[a-z0-9]+")
_ANY = re.compile(r"[^\W_]+")


def split_words(text: str) -> list[str]:
    """Words of ``text`` without case; ``_`` and everything else that is no letter or digit separates."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 1 << 20):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words: a polynomial over word hashes, mixed. Empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, size):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += hashes[j : j + n]
    return mix(acc)
