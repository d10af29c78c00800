"""What the classifiers share: choosing terms, and giving memory back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents looked at together while terms are counted.
_TOGETHER = 500


def examples_of(rows: pa.Table, order: str, terms: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The lists of ``terms`` as views, in the order of the column ``order``, and that order."""
    by = pc.sort_indices(rows[order]).to_numpy()
    views: list[np.ndarray] = []
    for chunk in rows[terms].chunks:
        at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        views += [flat[at[k] : at[k + 1]] for k in range(len(chunk))]
    return [views[k] for k in by], by


def chosen_terms(
    examples: list[np.ndarray], y: np.ndarray, classes: int, size: int, most: int, least_chi: float, least_docs: int
) -> tuple[np.ndarray, np.ndarray]:
    """The terms (below ``size``) whose presence says most about a class, by chi-square, and presence by document."""
    n = len(examples)
    hits = np.zeros((classes, size), np.int32)
    for a in range(0, n, _TOGETHER):
        for c in range(classes):
            own = [examples[k] for k in range(a, min(a + _TOGETHER, n)) if y[k] == c]
            if own:
                hits[c] += np.bincount(np.concatenate(own), minlength=size).astype(np.int32)
    seen = hits.sum(0, dtype=np.float64)
    chi = np.zeros(size)
    for c in range(classes):
        ones = float((y == c).sum())
        if 0 < ones < n:
            with np.errstate(divide="ignore", invalid="ignore"):
                own = (hits[c] * float(n) - seen * ones) ** 2 * n / (seen * (n - seen) * ones * (n - ones))
            chi = np.maximum(chi, np.nan_to_num(own))
    chi[seen < least_docs] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    best = np.sort(best[chi[best] >= least_chi])
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.uint8)
    for k, own in enumerate(examples):
        at = slot[own]
        x[k, at[at >= 0]] = 1
    return best, x


def give_back() -> None:
    """Return what this process no longer uses to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving memory back when its partition ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
