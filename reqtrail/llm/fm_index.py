"""Substring dedup: a compressed FM-index per shard, with backward search over a wavelet matrix.

A shard holds the word segments of some keys (see repeats), each with the smallest document that holds it. The index
is the Burrows-Wheeler transform of its words in a wavelet matrix of bit-packed levels, with the least documents
over suffix ranges from block minima. Segments are streamed against it: a backward search extends a match to the left while
the suffix range has a document smaller than the segment's own, which gives its matching statistics; windows whose
statistic reaches 50 words are reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Windows
from .common import string_buffers, white_cuts, word_hashes
from .repeats import covered, found_batch, groups, keyed, left, removed, repeated_windows, runs

LENGTH, SPREAD, RUN = 50, 30, 3
WINDOWS = Windows(LENGTH, SPREAD, RUN)
#: Bytes of rows in one index, eight for a word, but for a key that alone has more.
SEARCH_BYTES = 4 << 20


class Bits:
    """Packed bits with the number of ones before any position: a count for each 64 bits and a population count inside."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(n, np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class RangeMinimum:
    """Least values over ranges: least ones from the start and to the end of each block, and a table of powers of two over the blocks."""

    WIDTH = 32

    def __init__(self, values: np.ndarray):
        self.last = np.iinfo(np.int32).max
        n = -(-len(values) // self.WIDTH)
        self.values = np.full(n * self.WIDTH, self.last, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n, self.WIDTH)
        self.up = np.minimum.accumulate(blocks, 1).ravel()
        self.down = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [blocks.min(1)]
        while 2 << (len(self.table) - 1) <= n:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo:hi], which is not empty."""
        first, last = lo // self.WIDTH, (hi - 1) // self.WIDTH
        out = np.minimum(self.down[lo], self.up[hi - 1])
        inside = np.flatnonzero(first == last)
        if len(inside):
            at = lo[inside][:, None] + np.arange(self.WIDTH)
            out[inside] = np.where(at < hi[inside][:, None], self.values[np.minimum(at, len(self.values) - 1)], self.last).min(1)
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                out[far[at]] = np.minimum(out[far[at]], np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << k)]))
        return out


class WaveletMatrix:
    """A sequence of small numbers, one packed level for each of their bits from the highest."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        self.shifts = list(range(bits - 1, -1, -1))
        for s in self.shifts:
            bit = (values >> s) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def place(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position at lands when the sequence is sorted by value, shifted by where the value begins."""
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros, strict=True):
            ones = level.ones(at)
            at = np.where((value >> s) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of segments of 64-bit words that begin at `at`; least[k] is the smallest document that holds segment k."""

    def __init__(self, words: np.ndarray, at: np.ndarray, least: np.ndarray, depth: int):
        self.alphabet, number = np.unique(words, return_inverse=True)
        # Each segment ends in the symbol 0; no pattern has one.
        sizes = np.diff(at)
        text = np.zeros(len(words) + len(sizes), np.int64)
        where = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text[where] = number + 1
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        order = self.suffixes(text, depth)
        n = len(text)
        last = text[order - 1]
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        self.matrix = WaveletMatrix(last, self.bits)
        symbols = np.arange(len(self.alphabet) + 1)
        self.begin = np.searchsorted(np.sort(text), symbols)
        self.shift = self.begin - self.matrix.place(symbols, np.zeros(len(symbols), np.int64))
        self.size = n
        self.documents, rank = np.unique(least, return_inverse=True)
        self.minimum = RangeMinimum(rank[owner[order]].astype(np.int32))

    @staticmethod
    def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Order of the suffixes by their first `depth` symbols, by doubling."""
        rank, k, n = text.copy(), 1, len(text)
        order = np.argsort(rank, kind="stable")
        while k < depth:
            nxt = np.zeros(n, np.int64)
            nxt[:-k] = rank[k:] + 1 if k < n else 0
            key = rank * (int(nxt.max()) + 1) + nxt
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            if rank.max() == n - 1:
                break
            k *= 2
        return order

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after a symbol is put before the match."""
        both = self.matrix.place(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.shift[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def windows(self, symbols: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
        """For segments of symbols (numbers of the alphabet from 1): which windows, in order, occur in a smaller document.

        A search goes from an end leftwards to the first window that is still open. If it gets there, all windows up
        to that end occur. If not, no match covers the stretch on which it failed: the end moves halfway towards the
        window's own, and where it is that already, all windows over the stretch are skipped.
        """
        n = np.diff(at) - length + 1
        base = np.cumsum(n) - n
        found = np.zeros(int(n.sum()) + 1, np.int64)  # starts and ends of runs of windows
        bound = np.searchsorted(self.documents, ids).astype(np.int32)
        row, first, last = np.arange(len(n)), np.zeros(len(n), np.int64), n - 1  # windows from first to last are tried at once
        barred, cap = np.full(len(n), -1, np.int64), n - 1  # up to the window `barred` none later than `cap` can be in the same match
        while len(row):
            end = last + length  # of the stretch, in its segment
            active = np.arange(len(row))
            lo, hi = np.zeros(len(row), np.int64), np.full(len(row), self.size, np.int64)
            stop = np.full(len(row), -1, np.int64)
            k = end - 1
            while len(active):
                r = row[active]
                a, b = self.extend(symbols[at[r] + k[active]], lo[active], hi[active])
                good = b > a
                good[good] = self.minimum.of(a[good], b[good]) < bound[r[good]]
                stop[active[~good]] = k[active[~good]]
                active = active[good]
                lo[active], hi[active] = a[good], b[good]
                k[active] -= 1
                active = active[k[active] >= first[active]]
            won = stop < 0
            np.add.at(found, base[row[won]] + first[won], 1)
            np.add.at(found, base[row[won]] + last[won] + 1, -1)
            short = ~won & (last == first)
            halved = ~won & ~short
            barred, cap = np.where(halved, stop, barred), np.where(halved, last - 1, cap)
            first = np.where(won, last + 1, np.where(short, stop + 1, first))
            free = first > barred
            most = n[row] - 1
            cap = np.where(free, most, cap)
            last = np.where(halved, (first + last) // 2, np.maximum(cap, first))
            going = first <= most
            row, first, last, barred, cap = (x[going] for x in (row, first, last, barred, cap))
        return np.cumsum(found[:-1]) > 0


def as_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, unchanged."""
    words, first = [], [np.zeros(1, np.int64)]
    for some, at in word_hashes(data, offsets):
        first.append(at[1:] + first[-1][-1])
        words.append(some)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(first)


def _search(batches):
    for table in groups(batches, SEARCH_BYTES):
        data, at = string_buffers(table.column("symbols"))
        words, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
        ids = np.asarray(table.column("_id"))
        index = FMIndex(words, at, ids, LENGTH + SPREAD)
        found = index.windows(np.searchsorted(index.alphabet, words) + 1, at, ids, LENGTH)
        n = np.diff(at) - LENGTH + 1
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        first, last = runs(found, begin)
        yield found_batch(table, row[first], np.asarray(table.column("first"))[row[first]] + first - begin[row[first]], last - first)


REMOVED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _finish(batches):
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        rows = []
        for k in range(batch.num_rows):
            firsts = batch.column(2)[k].as_py()
            gone = covered(firsts, batch.column(3)[k].as_py(), LENGTH) if firsts else []
            digest, n, lead = hashlib.sha256(), 0, b""
            cuts = white_cuts(data, int(offsets[k]), int(offsets[k + 1]))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                words = data[x:y].tobytes().split()  # at the same six characters
                for a, b in left([(a - n, b - n) for a, b in gone if b > n], len(words)) if gone else [(0, len(words))]:
                    part = words[max(0, a) : b]
                    if part:
                        digest.update(lead + b" ".join(part))
                        lead = b" "
                n += len(words)
            rows.append((n, sum(b - a for a, b in gone), digest.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.string()], strict=True))], names=[x.split()[0] for x in REMOVED.split(", ")])


def repeated_words(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, after removal of each word that a repeated window of 50 words covers.

    A window is removed if its words also begin in a row with a smaller id; windows are judged on the input. Null text
    has no words. A null id counts as the largest; rows that repeat an id do not remove each other's words. An empty
    table gives no rows; other columns are ignored. Words are compared by 64-bit hashes.
    """
    rows = keyed(docs, text, ident)
    found = repeated_windows(rows, as_words, WINDOWS, _search, smaller_only=True)
    return removed(rows, found, _finish, REMOVED)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
least AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM windows JOIN least USING (h) WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
