"""Static binary-fuse filters (Graf and Lemire 2022), built with numpy.

A filter answers "surely absent" or "perhaps present" for 64-bit keys in about
9 bits a key: three cells, each in one of three neighbouring segments, XOR to
the key's 8-bit fingerprint.  It is built once from a fixed set of keys and
never changed, which suits an immutable snapshot.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _cells(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three cells a key: in a run of three segments, one in each."""
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * length
    mask = np.uint64(length - 1)
    a = (h & mask).astype(np.int64)
    b = ((h >> np.uint64(18)) & mask).astype(np.int64) ^ ((h >> np.uint64(5)) & mask).astype(np.int64)
    c = (_mix(h, 0x9E3779B9) & mask).astype(np.int64)
    return np.stack([base + a, base + length + b, base + 2 * length + c])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter over the distinct 64-bit ``keys``; no keys give one that holds nothing."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    length = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // length) - 2)
    for seed in range(1, 1000):
        if seed % 8 == 0:  # an unlucky size: a little more room
            segments += max(1, segments // 8)
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        cells = _cells(h, length, segments)
        size = length * (segments + 2)
        degree = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        index = np.arange(n)
        for row in cells:
            np.bitwise_xor.at(owner, row, index)
        rounds, left = [], n
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            who, at = np.unique(owner[alone], return_index=True)
            rounds.append((who, alone[at]))
            left -= len(who)
            touched = cells[:, who].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(who, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if left:
            continue
        table = np.zeros(size, dtype=np.uint8)
        print_of = _fingerprint(h)
        for who, at in reversed(rounds):
            a, b, c = cells[:, who]
            table[at] = print_of[who] ^ table[a] ^ table[b] ^ table[c] ^ table[at]
        return _HEAD.pack(seed, length, segments, n) + table.tobytes()
    raise RuntimeError("no seed gave a solvable filter")


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, False if it is surely absent."""
    seed, length, segments, n = _HEAD.unpack_from(filter_)
    keys = np.asarray(keys, dtype=np.uint64)
    if not n:
        return np.zeros(len(keys), dtype=bool)
    table = np.frombuffer(filter_, dtype=np.uint8, offset=_HEAD.size)
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
    a, b, c = _cells(h, length, segments)
    return (table[a] ^ table[b] ^ table[c]) == _fingerprint(h)
