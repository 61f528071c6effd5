"""The parts that both repeated-passage operators share: segments, keys that repeat, texts of what is open, and removal.

Every row is cut into segments (see anchors). A key that occurs once has no equal windows. Of the segments with a
repeated key, those that are equal as a whole are settled at once; the others are open: their symbols go to
partitions by key, where the operator's own search finds which of their windows repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Windows, segments
from .common import LARGEST, STEP_BYTES, discard, materialise, release, steps, string_buffers, tidy

#: Distinct segments of one key that are searched together.
MOST_SEGMENTS = 20_000

Splitter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(_id, _row, doc_id, _text): the id (null: the largest number) and a hash of the text, which name a row."""
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return docs.select(F.coalesce("doc_id", F.lit(LARGEST)).alias("_id"), F.xxhash64("_text").alias("_row"), "doc_id", "_text")


def parts(symbols: np.ndarray, offsets: np.ndarray, windows: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """segments(); those of a long row come by stretches of its windows, so that a segment may come in two."""
    if len(offsets) > 2 or len(symbols) <= STEP_BYTES:
        yield segments(symbols, offsets, windows)
        return
    for a in range(0, len(symbols) - windows.length + 1, STEP_BYTES // 2):
        some = symbols[a : a + STEP_BYTES // 2 + windows.length - 1]
        row, first, last, key, whole = segments(some, np.array([0, len(some)]), windows)
        yield row, first + a, last + a, key, whole


def _cut(split: Splitter, windows: Windows):
    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for i, j in steps(offsets):
                for row, first, last, key, whole in parts(*split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), windows):
                    at = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64))],
                        names=["_id", "_row", "first", "more", "key", "whole"],
                    )

    return run


def _fetch(split: Splitter, windows: Windows):
    """Symbols of the wanted segments of each text."""
    names = ["key", "whole", "_id", "_row", "first", "more", "blocks", "symbols"]

    def run(batches):
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            wanted = batch.column(3)
            for i, j in steps(offsets):
                symbols, at = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for k in range(i, j):
                    base = at[k - i]
                    for w in wanted[k].as_py():
                        a = base + w["first"]
                        rows.append((w["key"], w["whole"], batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), w["first"], w["more"], w["blocks"], symbols[a : a + w["more"] + windows.length].tobytes()))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


OPEN = "key bigint, whole bigint, _id bigint, _row bigint, first bigint, more int, blocks int, symbols binary"
FOUND = "_id bigint, _row bigint, first bigint, more int"


def groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of whole keys from rows that are sorted by key, of about `limit` bytes each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            whole = pa.Table.from_batches(held)
            keys = np.asarray(whole.column("key"))
            cut = int(np.searchsorted(keys, keys[-1]))
            at = 0
            while at < cut:
                # About the limit at a time, and no key in two.
                stop = int(np.searchsorted(keys, keys[min(cut - 1, at + max(1, limit * whole.num_rows // size))], "right"))
                stop = min(stop, cut)
                yield whole.slice(at, stop - at)
                at = stop
            rest = whole.slice(cut)
            held, size = rest.to_batches(), sum(b.nbytes for b in rest.to_batches())
    if held:
        yield pa.Table.from_batches(held)


def runs(flags: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of runs of true flags, where a run ends before each of begins."""
    up, down = flags.copy(), flags.copy()
    edge = np.zeros(len(flags), bool)
    edge[begins[begins < len(flags)]] = True
    up[1:] &= ~flags[:-1] | edge[1:]
    down[:-1] &= ~flags[1:] | edge[1:]
    return np.flatnonzero(up), np.flatnonzero(down)


def found_batch(table: pa.Table, pick: np.ndarray, first: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    take = pa.array(pick)
    col = lambda c: table.column(c).combine_chunks().take(take) if len(pick) else pa.array([], pa.int64())
    return pa.RecordBatch.from_arrays([col("_id"), col("_row"), pa.array(first.astype(np.int64)), pa.array(more.astype(np.int32))], names=["_id", "_row", "first", "more"])


def repeated_windows(docs: DataFrame, split: Splitter, windows: Windows, search: Callable, smaller_only: bool) -> DataFrame:
    """Runs of windows (_id, _row, first, more) that occur elsewhere: for smaller_only, in a row with a smaller id.

    docs as from keyed(). search maps the open segments, sorted by key, to runs of windows. The rows of a key with
    more than MOST_SEGMENTS distinct segments are searched by pairs of blocks, so that no task holds them all.
    """
    cut = docs.select("_id", "_row", "_text").mapInArrow(tidy(_cut(split, windows)), "_id bigint, _row bigint, first bigint, more int, key bigint, whole bigint")
    name = F.xxhash64("_id", "_row", "first")
    # Counts, the smallest id, and one segment to show for each kind; then the kinds of each key.
    kinds = cut.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min("_id").alias("least"), F.min_by(name, "_id").alias("shown"))
    kinds = materialise(kinds, "kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).filter("total > 1").drop("total")
    kinds_ = materialise(kinds.join(keys, "key"), "kinds")
    discard(kinds)
    rows = cut.join(kinds_, ["key", "whole"])
    settled = F.col("_id") > F.col("least") if smaller_only else F.col("n") > 1
    asks = ~settled & (F.col("kinds") > 1)
    shows = (F.col("kinds") > 1) & (name == F.col("shown"))
    rows = rows.withColumn("settled", settled).withColumn("open", asks | shows).filter("settled OR open")
    of_open = lambda c: F.when(F.col("open"), F.col(c)).alias(c)
    blocks = F.ceil(F.col("kinds") / MOST_SEGMENTS).cast("int")
    rows = materialise(rows.select("_id", "_row", "first", "more", of_open("key"), of_open("whole"), "settled", "open", F.when(F.col("open"), blocks).alias("blocks")), "segments")
    discard(kinds_)
    release(docs.sparkSession)
    wanted = rows.filter("open").groupBy("_id", "_row").agg(F.collect_set(F.struct("key", "whole", "first", "more", "blocks")).alias("_wanted"))
    met = docs.select("_id", "_row", "_text").join(wanted, ["_id", "_row"]).select("_id", "_row", "_text", "_wanted")
    fetched = met.mapInArrow(tidy(_fetch(split, windows)), OPEN)
    block = F.pmod("whole", "blocks")
    pair = F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other"))
    dealt = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("key", F.when(F.col("blocks") > 1, pair).otherwise(F.col("key")))
    found = materialise(dealt.drop("other", "blocks").repartition("key").sortWithinPartitions("key", "whole").mapInArrow(tidy(search), FOUND), "runs")
    release(docs.sparkSession)
    return rows.filter("settled").select("_id", "_row", "first", "more").unionByName(found)


def removed(docs: DataFrame, found: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(ids, texts, runs) over all rows of docs, where runs are the lists of (first, more) of each row, or null."""
    lists = found.groupBy("_id", "_row").agg(F.collect_set(F.struct("first", "more")).alias("_runs"))
    met = docs.join(lists, ["_id", "_row"], "left").select("doc_id", "_text", F.col("_runs.first").alias("firsts"), F.col("_runs.more").alias("mores"))
    return met.mapInArrow(tidy(finish), schema)


def covered(firsts: list[int], mores: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal stretches [a, b) that windows of the runs cover, ascending; they do not touch."""
    out: list[list[int]] = []
    for a, b in sorted((f, f + m + length) for f, m in zip(firsts, mores, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def left(stretches: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What the stretches leave of n symbols."""
    ends = [0, *(b for _, b in stretches)]
    return [(x, y) for x, y in zip(ends, [*(a for a, _ in stretches), n], strict=True) if x < y]
