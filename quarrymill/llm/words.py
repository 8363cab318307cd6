"""Words and hashed runs of words, equal in every process."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


class WordHash(dict):
    """Word to 64-bit hash, the same in every process."""

    def __missing__(self, w: str) -> int:
        h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 2_000_000:
            self.clear()
        self[w] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def gram_set(words: list[str], size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc = _mix((acc + h[i : i + n]) * _M1 + _M3)
    return np.unique(acc)
