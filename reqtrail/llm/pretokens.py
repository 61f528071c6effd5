"""Splitting text by the byte-level BPE pattern, in numpy, and encoding its distinct pieces once.

The pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ depends only on the classes of
neighbouring code points, so piece starts come from a few array operations. Equal pieces are then encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import regex

from .common import RollingHash, steps, white_cuts

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Text for which the pieces are held at once, text that one numpy step works on, and pieces that a worker remembers between blocks (about 50 bytes each).
BLOCK_BYTES, PART_BYTES, REMEMBERED = 4 << 20, 1 << 20, 1_500_000


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def repaired(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose bytes are no UTF-8 get U+FFFD for what is wrong."""
    whole = data.tobytes()
    rows = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return np.frombuffer(b"".join(rows), np.uint8), at


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions in data, which is valid UTF-8, where pieces begin. Rows begin at offsets; no piece crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    kind = classes()[points]
    rows = np.searchsorted(place, offsets[:-1][offsets[:-1] < len(data)])
    begins = np.zeros(n + 1, bool)  # of a row
    begins[rows] = True
    begins[n] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last space of a run before other text stands alone; a blank joins what follows.
    before = np.zeros(n, bool)  # a space with other text of its row behind it
    before[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n]
    start |= before
    blank = before & (points == 32)
    start[1:] &= ~blank[:-1]
    # Contractions: an apostrophe that begins a piece, with letters behind it in its row.
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        here = lambda at: np.where((at < n), points[np.minimum(at, n - 1)], 0)
        free = lambda at: (at < n) & ~begins[np.minimum(at, n)]
        one, two = here(quote + 1), here(quote + 2)
        ok1, ok2 = free(quote + 1), free(quote + 1) & free(quote + 2)
        is_one = ok1 & np.isin(one, [ord(c) for c in "stmd"])
        is_two = ok2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[is_one], 2), (quote[is_two], 3)):
            for k in range(1, size):
                start[at + k] = False
            after = at + size
            start[after[after < n]] = True
    return place[np.flatnonzero(start)]


class Dictionary:
    """Distinct pieces by a 64-bit key with what encode() gives for them: a row of ids each.

    Keys of up to seven bytes are the bytes themselves; longer pieces have a 63-bit hash of their bytes and length.
    Each of the strings in whole is a piece wherever it occurs, and texts are split at them before pieces are cut.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED, whole: tuple[bytes, ...] = ()):
        self.encode, self.remembered = encode, remembered
        self.whole = tuple(sorted(whole, key=len, reverse=True))  # the longest of those that begin at one place is found
        self.find = re.compile(b"|".join(map(re.escape, self.whole)))
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def key(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        key = RollingHash(data).of(starts, ends) | np.uint64(1 << 63)
        short = np.flatnonzero(size <= 7)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.zeros(len(short), np.uint64)
        for k in range(7):
            word |= np.where(size[short] > k, padded[starts[short] + k], 0).astype(np.uint64) << np.uint64(8 * k)
        key[short] = word | (size[short].astype(np.uint64) << np.uint64(56))
        return key

    def add(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Learn pieces that are not held yet; keys ascend."""
        ids, counts = self.encode(texts)
        first = len(self.at) - 1
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.rows = np.insert(self.rows, where, first + np.arange(len(keys)))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        where = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        found[inside] = self.keys[where[inside]] == keys[inside]
        return ~found

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """pieces(), with the strings in whole kept as they are."""
        text = data.tobytes() if self.whole else b""
        if not any(t in text for t in self.whole):
            return pieces(data, offsets)
        found = [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.find.finditer(text, a, b)]
        if not found:
            return pieces(data, offsets)
        begin, end = np.array(found, np.int64).T
        starts = pieces(data, np.unique(np.concatenate([offsets, begin, end])))
        last = np.searchsorted(begin, starts, "right") - 1
        return starts[(last < 0) | (starts == begin[last]) | (starts >= end[last])]

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For blocks of rows i to j: i, j, each piece's row in this dictionary, and where each text row's pieces begin.

        A row of several PART_BYTES is cut where white space follows something else, which begins a piece anyway.
        """
        for i, j in steps(offsets, BLOCK_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(self.keys) > self.remembered:
                self.clear()
            keys, counts, unseen, texts = [], [], [], []
            long = np.flatnonzero(np.diff(at) > 2 * PART_BYTES).tolist()
            fine = np.unique(np.concatenate([at, *(white_cuts(part, int(at[k]), int(at[k + 1]), PART_BYTES) for k in long)])).astype(np.int64) if long else at
            for a, b in steps(fine, PART_BYTES):
                text, cut = part[fine[a] : fine[b]], fine[a : b + 1] - fine[a]
                try:
                    starts = self.starts(text, cut)
                except UnicodeDecodeError:
                    text, cut = repaired(text, cut)
                    starts = self.starts(text, cut)
                ends = np.append(starts[1:], len(text))[: len(starts)]
                key = self.key(text, starts, ends)
                distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
                new = self.missing(distinct)
                whole = text.tobytes()
                unseen.append(distinct[new])
                texts += [whole[x:y] for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                keys.append((distinct, back))
                counts.append(np.diff(np.searchsorted(starts, cut)))
            fresh, pick = np.unique(np.concatenate(unseen), return_index=True)
            if len(fresh):
                self.add(fresh, [texts[k] for k in pick.tolist()])
            rows = np.concatenate([self.rows[np.searchsorted(self.keys, distinct)][back] for distinct, back in keys])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield i, j, rows, ends if fine is at else ends[np.searchsorted(fine, at)]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in order, and how many each has."""
        return take(self.ids, self.at, rows)


def take(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[r]:at[r+1]] for each r, joined; and their lengths."""
    sizes = at[rows + 1] - at[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.repeat(at[rows] - (ends - sizes), sizes) + np.arange(total)
    return flat[where], sizes
