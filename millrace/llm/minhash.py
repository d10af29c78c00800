"""Min-wise signatures of shingle sets."""

from __future__ import annotations

import numpy as np

from .textkernel import mix64, shingles, words

_U = np.uint64
#: Rows of a set hashed at once against all functions, to stay in cache.
_BLOCK = 512


class MinHash:
    """``count`` hash functions; a signature has the 16 top bits of each function's least value."""

    def __init__(self, count: int, seed: int = 1):
        self.count = count
        self.factor = mix64(np.arange(1, count + 1, dtype=np.uint64) + _U(seed * 1_000_003)) | _U(1)

    def signature(self, own: np.ndarray) -> np.ndarray:
        least = np.full(self.count, _U(2**64 - 1))
        for a in range(0, len(own), _BLOCK):
            least = np.minimum(least, (own[a : a + _BLOCK, None] * self.factor).min(0))
        return (mix64(least) >> _U(48)).astype(np.uint16)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text of a slice."""
    flat, bounds = shingles(words(offsets, data), size)
    for k in range(len(bounds) - 1):
        yield np.unique(flat[bounds[k] : bounds[k + 1]])
