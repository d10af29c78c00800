"""Token ids of a lower-casing word BPE vocabulary, many words at once.

The vocabulary file is one of the public tokenizers (kind: BPE with word ends,
lower case, white space dropped).  Ids equal those of the ``tokenizers``
library without special tokens.  Texts are cut into words on arrays of code
points, each distinct word is merged once, all words of a slice in step, and
the ids are put back in order.  Texts with characters whose handling is not
settled by one code point (unnormalised marks, rare planes, the special
tokens' own strings) go to the library itself, whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textkernel import mix64, powers

#: Code points below this are taken by table.
LIMIT = 0x2E80
#: Words of more bytes go to the library one by one.
LONGEST = 48
#: Distinct words remembered by a process; beyond it the memory starts anew.
REMEMBERED = 400_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: The white space of Unicode.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, low, odd = np.full(LIMIT, _OTHER, np.uint8), np.arange(LIMIT, dtype=np.uint32), np.zeros(LIMIT, bool)
    for c in range(LIMIT):
        x = chr(c)
        lowered = x.lower()
        if len(lowered) != 1 or ord(lowered) >= LIMIT or unicodedata.category(x) == "Cn":
            odd[c] = True
            continue
        low[c] = ord(lowered)
        group = unicodedata.category(lowered)[0]
        kind[c] = _SPACE if x in _WHITE else _LETTER if group == "L" else _NUMBER if group == "N" else _OTHER
    return kind, low, odd


class _Pairs:
    """Ranks of symbol pairs in a few hash tables without collisions."""

    def __init__(self, keys: np.ndarray):
        self.tables = []
        rank = np.arange(len(keys), dtype=np.int32)
        for seed in range(1, 50):
            if not len(keys):
                break
            bits = max(10, int(np.ceil(np.log2(len(keys) * 10))))
            multiplier = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64) | 1)
            slot = (keys * multiplier) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            own, ranks = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, 2**31 - 1, np.int32)
            own[slot[first]], ranks[slot[first]] = keys[first], rank[first]
            self.tables.append((multiplier, np.uint64(64 - bits), own, ranks))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, rank = keys[left], rank[left]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(key.shape, 2**31 - 1, np.int32)
        for multiplier, shift, own, ranks in self.tables:
            slot = (key * multiplier) >> shift
            hit = own[slot] == key
            out[hit] = ranks[slot[hit]]
        return out


class WordBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        model = json.loads(self.library.to_str())
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        end = model["model"]["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.special = [t["content"] for t in model["added_tokens"]]
        # Bytes that print stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[sign[b] + end] for b in range(256)], np.int32)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.uint64)
        self.pairs = _Pairs((pairs[:, 0] << np.uint64(32)) | pairs[:, 1])
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.kind, self.low, self.odd = _tables()
        self.value = mix64(np.arange(1, LIMIT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros((0, 2), np.int64)
        self.ids = np.zeros(0, np.int32)

    def _merge(self, grid: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of symbols (padded by -1) as far as they go: lowest rank first, leftmost first."""
        done = np.iinfo(np.int32).max
        out, width = grid.copy(), grid.shape[1]
        if width < 2:
            return out, size
        row = np.arange(len(grid))
        rank = self.pairs.rank(grid[:, :-1], grid[:, 1:])
        rank[np.arange(width - 1) >= (size - 1)[:, None]] = done
        final = size.copy()
        columns = np.arange(width)
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            live = best < done
            if not live.all():
                out[row[~live]] = grid[~live]
                final[row[~live]] = size[~live]
                row, grid, rank, at, best, size = row[live], grid[live], rank[live], at[live], best[live], size[live]
                if not len(row):
                    break
            each = np.arange(len(row))
            grid[each, at] = self.merged[best]
            move = columns[None, :] > at[:, None]
            move[:, -1] = False
            grid = np.where(move, np.roll(grid, -1, 1), grid)
            grid[:, -1] = np.where(size == width, -1, grid[:, -1])
            size = size - 1
            move = move[:, :-1]
            rank = np.where(np.concatenate([move[:, :-1], np.zeros((len(row), 1), bool)], 1), np.roll(rank, -1, 1), rank)
            left, right = at - 1, at
            some = left >= 0
            rank[each[some], left[some]] = self.pairs.rank(grid[each[some], left[some]], grid[each[some], at[some]])
            some = right + 1 < size
            rank[each[some], right[some]] = self.pairs.rank(grid[each[some], right[some]], grid[each[some], right[some] + 1])
            rank[each[~some], right[~some]] = done
            beyond = np.arange(width - 1)[None, :] >= (size - 1)[:, None]
            rank[beyond] = done
        return out, final

    def _words(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Learn the words at ``points[start : start + length]``; their rows join ``known_at`` in order."""
        total = int(length.sum())
        flat = points[np.repeat(start - np.cumsum(length) + length, length) + np.arange(total)]
        data = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800)
        ends = np.cumsum(width)
        size = np.diff(ends[np.cumsum(length) - 1], prepend=0)
        begin = np.cumsum(size) - size
        parts, order = [], []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, LONGEST):
            who = np.flatnonzero((size > low) & (size <= high))
            low = high
            if not len(who):
                continue
            columns = np.arange(high)
            valid = columns[None, :] < size[who][:, None]
            raw = data[np.minimum(begin[who][:, None] + columns, len(data) - 1)]
            grid = np.where(valid, self.inner[raw], -1)
            each = np.arange(len(who))
            grid[each, size[who] - 1] = self.last[raw[each, size[who] - 1]]
            grid, final = self._merge(grid, size[who])
            parts.append(grid[columns[None, :] < final[:, None]])
            order.append((who, final))
        for r in np.flatnonzero(size > LONGEST):
            word = flat[np.cumsum(length)[r] - length[r] : np.cumsum(length)[r]].astype("<u4").tobytes().decode("utf-32-le")
            parts.append(np.array(self.library.encode(word, add_special_tokens=False).ids, np.int32))
            order.append((np.array([r]), np.array([len(parts[-1])])))
        at = np.zeros((len(size), 2), np.int64)
        who, count = np.concatenate([o[0] for o in order]), np.concatenate([o[1] for o in order])
        at[who, 0] = len(self.ids) + np.cumsum(count) - count
        at[who, 1] = count
        self.ids = np.concatenate([self.ids, *parts])
        self._fresh = at

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose UTF-8 bytes are ``data[offsets[i] : offsets[i + 1]]``: all in a row, and bounds."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            edge = offsets
        else:
            edge = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        slow = self._slow(text, points, edge)
        counts = np.zeros(rows, np.int64)
        fast_ids = np.zeros(0, np.int32)
        if not slow.all():
            if slow.any():  # blank out the texts that the library takes
                points = points.copy()
                for r in np.flatnonzero(slow):
                    points[edge[r] : edge[r + 1]] = 32
            fast_ids, counts = self._fast(points, edge)
        if not slow.any():
            return fast_ids, np.concatenate([[0], np.cumsum(counts)])
        pieces, at = [], 0
        for r in range(rows):
            if slow[r]:
                own = np.array(self.library.encode(text[edge[r] : edge[r + 1]], add_special_tokens=False).ids, np.int32)
                counts[r] = len(own)
                pieces.append(own)
            else:
                pieces.append(fast_ids[at : at + counts[r]])
                at += counts[r]
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(counts)])

    def _slow(self, text: str, points: np.ndarray, edge: np.ndarray) -> np.ndarray:
        slow = np.zeros(len(edge) - 1, bool)
        high = np.flatnonzero(points >= 0x300)
        if len(high):
            for r in np.unique(np.searchsorted(edge, high, side="right") - 1):
                own = points[edge[r] : edge[r + 1]]
                slow[r] = (own >= LIMIT).any() or not unicodedata.is_normalized("NFC", text[edge[r] : edge[r + 1]])
        strange = np.flatnonzero(self.odd[np.minimum(points, LIMIT - 1)] & (points < LIMIT))
        slow[np.searchsorted(edge, strange, side="right") - 1] = True
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                slow[np.searchsorted(edge, at, side="right") - 1] = True
                at = text.find(token, at + 1)
        return slow

    def _fast(self, points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(edge) - 1
        n = len(points)
        low = self.low[points]
        kind = self.kind[points]
        inside = kind != _SPACE
        start = inside & (kind == _NUMBER)
        start[0] = inside[0]
        start[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        first = edge[:-1][edge[:-1] < edge[1:]]
        start[first] = inside[first]
        marks = np.flatnonzero((points == 39) & start)
        if len(marks):
            until = edge[np.searchsorted(edge, marks, side="right")]
            next_ = lambda k: np.where(marks + k < until, low[np.minimum(marks + k, n - 1)], 0)
            a, b = next_(1), next_(2)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            both = one | two
            marks, until, size = marks[both], until[both], np.where(one, 2, 3)[both]
            start[marks + 1] = False
            end = marks + size
            more = end < until
            end = end[more]
            start[end] |= kind[end] == _LETTER
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        spans = np.diff(at, append=n)
        place = np.arange(at[0], n, dtype=np.int64) - np.repeat(at, spans)
        term = self.value[low[at[0] :]]
        term[~inside[at[0] :]] = 0
        term *= powers(int(place.max()) + 1)[place]
        hash_ = mix64(np.add.reduceat(term, at - at[0]))
        coded = pa.array(hash_).dictionary_encode()
        distinct = coded.dictionary.to_numpy()
        which = coded.indices.to_numpy()
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        spot = np.searchsorted(self.known, distinct)
        if len(self.known):
            new = self.known[np.minimum(spot, len(self.known) - 1)] != distinct
        else:
            new = np.ones(len(distinct), bool)
        if new.any():
            where = np.zeros(len(distinct), np.int64)
            where[which[::-1]] = np.arange(len(which))[::-1]
            ones = where[new]
            count = np.add.reduceat(inside[at[0] :].astype(np.int64), at - at[0])
            self._words(low, at[ones], count[ones])
            keys = np.concatenate([self.known, distinct[new]])
            order = np.argsort(keys)
            self.known, self.known_at = keys[order], np.concatenate([self.known_at, self._fresh])[order]
            spot = np.searchsorted(self.known, distinct)
        place_of = self.known_at[spot][which]
        size = place_of[:, 1]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(place_of[:, 0] - ends + size, size) + np.arange(ends[-1])]
        word_row = np.searchsorted(at, edge)
        token_edge = np.concatenate([[0], ends])[word_row]
        return ids, np.diff(token_edge)
