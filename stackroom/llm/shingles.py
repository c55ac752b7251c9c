"""Hashes of word shingles in numpy, for the operators that work on whole texts inside Python tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
SHINGLE_WORDS = 5

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32 = np.uint64(29), np.uint64(32)


class _WordHashes(dict):
    """Hash of each word seen; emptied when it grows too large for a worker."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return out


_hash_of = _WordHashes().__getitem__


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return _WORD.findall(text.lower()) if text else []


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for every run of `size` words, in order; a shorter text with words is one shingle."""
    found = words(text)
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_hash_of, found), np.uint64, n)
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out ^= out >> _S29
        out *= _ODD
        out += hashes[i : n - size + 1 + i]
    out ^= out >> _S32
    out *= _ODD
    return out ^ (out >> _S29)
