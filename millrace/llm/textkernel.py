"""Vectorised word hashing over Arrow text columns.

Texts are taken as their UTF-8 bytes in slices of bounded size, so memory is
bounded by the slice (or by one text, if that is longer) and no Python object
is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 512 << 10

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE)
    out[0] = 1
    return np.cumprod(out)


def _byte_table(space: bytes, drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its 64-bit value with A-Z lowered (0 where it is no part of a word), and whether it divides words."""
    cut = np.zeros(256, dtype=bool)
    cut[list(space)] = True
    low = np.arange(256)
    low[65:91] += 32
    value = mix64((low + 1).astype(np.uint64) * _BASE)
    value[cut] = 0
    value[list(drop)] = 0
    return value, cut


#: The six ASCII white-space characters.
WHITE = b" \t\n\x0b\x0c\r"
_PLAIN = _byte_table(WHITE)
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BARE = _byte_table(WHITE + _PUNCTUATION)


class Words:
    """The words of ``rows`` texts: ``hash`` of each in order, and ``bounds`` (rows + 1) of each text's words."""

    __slots__ = ("bounds", "hash")

    def __init__(self, hash_: np.ndarray, bounds: np.ndarray):
        self.hash, self.bounds = hash_, bounds


def _string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string array; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, offsets from 0, bytes)`` of runs of rows of at most ``most`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks at all
            column = pa.array([], pa.string())
    offsets, data = _string_buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def words(offsets: np.ndarray, data: np.ndarray, bare: bool = False) -> Words:
    """Words of a slice: runs without ASCII white space, A-Z lowered; ``bare``: also cut at ASCII punctuation."""
    value, cut = _BARE if bare else _PLAIN
    rows = len(offsets) - 1
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    inside = ~cut[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    at = np.flatnonzero(start)
    if not len(at):
        return Words(np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
    spans = np.diff(at, append=n)
    place = np.arange(at[0], n, dtype=np.int64) - np.repeat(at, spans)
    term = value[data[at[0] :]]
    long = int(place.max()) + 1
    if long > 1 << 16:  # a very long gap or word: its places are reduced where it has bytes
        term = term * _power_of(place)
    else:
        term *= powers(long)[place]
    hash_ = mix64(np.add.reduceat(term, at - at[0]))
    return Words(hash_, np.searchsorted(at, offsets))


def _power_of(place: np.ndarray) -> np.ndarray:
    low, high = powers(1 << 16), powers(1 << 16)
    step = low[-1] * _BASE
    high = np.cumprod(np.concatenate([[_U(1)], np.full(int(place.max() >> 16) + 1, step)]))
    return low[place & 0xFFFF] * high[place >> 16]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their bounds by row.

    A row with fewer words, but some, has its whole sequence as its only one.
    """
    counts = np.diff(w.bounds)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    n = len(w.hash)
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    p = powers(size + 1)
    run = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        run += w.hash[k : k + len(run)] * p[k]
    out = np.empty(bounds[-1], np.uint64)
    full = counts >= size
    rows = np.repeat(np.arange(len(counts)), each)
    inside = np.arange(bounds[-1]) - bounds[rows]
    wide = full[rows]
    out[wide] = run[(w.bounds[rows] + inside)[wide]]
    for r in np.flatnonzero((counts > 0) & ~full):
        own = w.hash[w.bounds[r] : w.bounds[r + 1]]
        out[bounds[r]] = (own * p[: len(own)]).sum(dtype=np.uint64, keepdims=True)[0] ^ _U(len(own) * 0xD6E8FEB86659FD93 % 2**64)
    return mix64(out), bounds


def terms(offsets: np.ndarray, data: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the terms of a slice: bare words, and the first bytes of longer ones by ``prefixes``.

    A word and a prefix of the same spelling are different terms.
    """
    value, cut = _BARE
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n:
        return none
    inside = ~cut[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    at = np.flatnonzero(start)
    if not len(at):
        return none
    spans = np.diff(at, append=n)
    place = np.arange(at[0], n, dtype=np.int64) - np.repeat(at, spans)
    term = value[data[at[0] :]]
    term *= powers(int(place.max()) + 1)[place] if place.max() < 1 << 16 else _power_of(place)
    rows = np.searchsorted(offsets, at, side="right") - 1
    hashes, owners = [mix64(np.add.reduceat(term, at - at[0]))], [rows]
    size = np.add.reduceat(inside[at[0] :].astype(np.int64), at - at[0]) if prefixes else None
    for p in prefixes:
        longer = size > p
        heads = at[longer] - at[0]
        if len(heads):
            own = term[heads[:, None] + np.arange(p)].sum(1, dtype=np.uint64)
            hashes.append(mix64(own + _U(p * 0xD6E8FEB86659FD93 % 2**64)))
            owners.append(rows[longer])
    return np.concatenate(hashes), np.concatenate(owners)
