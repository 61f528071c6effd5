"""Anchors: content-chosen positions that meet every window of a set length, so that equal windows can be found through few rows.

A window of L symbols takes as its anchor the position with the least hash of a short run of symbols, among W
positions inside the window (the first of equal ones). Equal windows therefore have their anchors at the same place,
with the same L + 1 - W symbols around them: the key. Neighbouring windows mostly share their anchor; those that do
form a segment. Windows can only be equal if their segments have the same key; segments that are equal as a whole
have all their windows equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import RollingHash, mixed

_FACTOR = np.random.default_rng(8).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Windows:
    """length: symbols in a window; spread: positions that may hold its anchor; run: symbols that are hashed at a position."""

    length: int
    spread: int
    run: int

    @property
    def before(self) -> int:
        """Symbols of the key before the anchor."""
        return (self.length + 1 - self.spread) // 2

    @property
    def after(self) -> int:
        """Symbols of the key from the anchor on; at least run."""
        return self.length + 1 - self.spread - self.before


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the first position of the least of x[i:i+width]."""
    n = len(x) - width + 1
    best, at, span = x, np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.where(right, b, a)
        span += step
    return at[:n]


def segments(symbols: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, ...]:
    """Segments of rows of symbols (bytes or 64-bit words) that begin at offsets.

    Returns row, first window, last window (both as offsets in the row), key, and the hash of all symbols of the
    segment's windows with the anchor's place in it.
    """
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n, size = len(symbols), windows.length
    if n < size:
        return nothing
    hashes = RollingHash(symbols)
    if symbols.dtype == np.uint8:
        padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
        x = np.ndarray((n,), np.uint64, padded.data, strides=(1,)).copy()
        if windows.run < 8:
            x &= np.uint64((1 << (8 * windows.run)) - 1)
        x *= _FACTOR[0]
        x ^= x >> np.uint64(29)
        x *= _FACTOR[1]
    else:
        x = np.zeros(n, np.uint64)
        for k in range(windows.run):
            x[: n - k] += symbols[k:] * _FACTOR[k]
        x = mixed(x)
    last = n - size + 1
    anchor = least_at(x[windows.before : windows.before + last + windows.spread - 1], windows.spread) + windows.before
    # Windows that end in the row they begin in.
    start = np.arange(last)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:last]
    inside = start + size <= offsets[row + 1]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    if not len(start):
        return nothing
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(start)) - 1
    a, b, at = start[first], start[end], anchor[first]
    key = hashes.of(at - windows.before, at + windows.after)
    whole = mixed(hashes.of(a, b + size) + (at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = row[first]
    return row, a - offsets[row], b - offsets[row], key, whole
