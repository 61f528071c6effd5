"""Suffix-array dedup: prefix doubling over the byte positions that may begin a repeated string.

Ranks of strings at growing offsets decide what repeats, and a position leaves as soon as its rank is unique. Spark
sorts positions first by the string of LENGTH + 1 - SPREAD bytes around their anchor, then by that rank together with
the rank of their whole segment (see repeats); what is left is ranked by doubling inside key partitions: pairs of ranks
50 bytes apart, then of 100 bytes apart, until unique or at the threshold of 200.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Windows
from .common import RollingHash, string_buffers
from .repeats import covered, found_batch, groups, keyed, left, removed, repeated_windows, runs

LENGTH, SPREAD, RUN = 200, 150, 8
WINDOWS = Windows(LENGTH, SPREAD, RUN)
#: Bytes of rows that are ranked together, but for a key that alone has more.
SEARCH_BYTES = 1 << 20


def as_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def ranked(pairs_left: np.ndarray, pairs_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs, and for each whether its rank is shared."""
    order = np.lexsort((pairs_right, pairs_left))
    a, b = pairs_left[order], pairs_right[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    rank = np.empty(len(order), np.int64)
    rank[order] = group
    return rank, np.bincount(group)[rank] > 1 if len(order) else np.zeros(0, bool)


def doubled(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the strings of `length` bytes that begin at starts (all inside data, sorted) occur at two or more of them.

    Ranks of quarter strings are paired to halves and those to whole ones; only positions whose halves are both shared
    get to the last round. length is a multiple of four.
    """
    quarter, half = length // 4, length // 2
    at = np.unique(np.concatenate([starts, starts + half]))
    hashes = RollingHash(data)
    rank, shared = ranked(hashes.of(at, at + quarter), hashes.of(at + quarter, at + half))
    left, right = np.searchsorted(at, starts), np.searchsorted(at, starts + half)
    out = np.zeros(len(starts), bool)
    alive = np.flatnonzero(shared[left] & shared[right])
    _, again = ranked(rank[left[alive]], rank[right[alive]])
    out[alive] = again
    return out


def _once(table: pa.Table) -> pa.Table:
    """Without segments that come again: those of a very hot key are in several pairs of blocks, which may meet in a table."""
    names = [np.asarray(table.column(c)) for c in ("first", "_row", "_id")]
    order = np.lexsort(names)
    same = np.zeros(len(order), bool)
    same[1:] = np.all([x[order[1:]] == x[order[:-1]] for x in names], 0)
    return table.take(pa.array(np.sort(order[~same]))) if same.any() else table


def _search(batches):
    for table in groups(batches, SEARCH_BYTES):
        table = _once(table)
        data, at = string_buffers(table.column("symbols"))
        n = np.asarray(table.column("more")).astype(np.int64) + 1
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        again = doubled(data, at[row] + off)
        first, last = runs(again, np.cumsum(n) - n)
        yield found_batch(table, row[first], np.asarray(table.column("first"))[row[first]] + off[first], last - first)


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _finish(batches):
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        rows = []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            firsts = batch.column(2)[k].as_py()
            gone = covered(firsts, batch.column(3)[k].as_py(), LENGTH) if firsts else []
            digest = hashlib.sha256()
            for a, b in left(gone, len(text)):
                digest.update(text[a:b])
            rows.append((len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=[x.split()[0] for x in REMOVED.split(", ")])


def repeated_bytes(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after removal of each byte that a repeated 200-byte string covers.

    A string repeats if it begins at any other place of any row, the same row included, overlaps too; all strings
    are judged on the input. Null text counts as empty. Rows that repeat an id, and rows with a null id, are rows of
    their own. An empty table gives no rows; other columns are ignored. Strings are compared by 64-bit hashes.
    """
    rows = keyed(docs, text, ident)
    found = repeated_windows(rows, as_bytes, WINDOWS, _search, smaller_only=False)
    return removed(rows, found, _finish, REMOVED)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, k, hash(array_slice(b, k, k + 199)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS k FROM d)),
often AS (SELECT h FROM strings GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, k, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM strings SEMI JOIN often USING (h)),
runs AS (SELECT doc_id, k, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hit),
spans AS (SELECT doc_id, r, min(k) AS a, max(k) + 200 AS z FROM runs GROUP BY 1, 2),
per AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends, sum(z - a) AS gone, count(*) AS n_spans FROM spans GROUP BY 1),
parts AS (SELECT d.doc_id, n, b, gone, n_spans, list_prepend(1, ends) AS x, list_append(starts, n + 1) AS y FROM d JOIN per USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(list_reduce(list_transform(range(1, len(x) + 1), lambda i: array_slice(b, x[i], y[i] - 1)), lambda p, q: p || q)) AS kept_sha256 FROM parts
UNION ALL SELECT doc_id, CAST(n AS BIGINT), 0, 0, sha256(b) FROM d ANTI JOIN per USING (doc_id)
"""
