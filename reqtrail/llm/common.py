"""Helpers that the training-data operators share: text buffers, hashes, skew-safe joins, tables."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kept import shared_folder

#: Bytes of text in one range of ids where there are more than a few, the least that a range is cut for, and the most ranges: their
#: bounds are literals of a plan. With more text ranges grow (2 GB each at 100 TB); what reads them sorts with spill and streams.
RANGE_BYTES, LEAST_RANGE_BYTES, MOST_RANGES = 24 << 20, 2 << 20, 50_000
#: Ids for each range from whose order the bounds come.
IDS_PER_RANGE = 40
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that one numpy step works on; arrays of eight bytes a byte stay near 50 MB.
STEP_BYTES = 1 << 20
#: Most bytes of a table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Stands for a null id where ids are ordered.
LARGEST = (1 << 63) - 1
#: Copies of a small side per key, so that one hot key is dealt to as many tasks.
SALTS = 16


def scratch(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all that the operators have written for this application, once no result of theirs is read any more."""
    removed_path(spark, scratch(spark))


def removed_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = table_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            removed_path(t.sparkSession, path)


def salted_left_join(rows: DataFrame, side: DataFrame, on: list[str], salts: int = SALTS) -> DataFrame:
    """rows left join side, where side has one row per key and a key may hold any part of rows.

    A key's rows go to `salts` tasks; side, which should hold only keys that matter, is repeated for each.
    Null keys match nothing and are spread over all salts.
    """
    if not on:
        raise ValueError("a key is needed")
    kinds = dict(rows.dtypes)
    dealt = [c for c in rows.columns if kinds[c] in ("bigint", "int")] or rows.columns
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*dealt), F.lit(salts)).cast("int"))
    spread = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], "left").drop("_salt")


def broadcast_below(side: DataFrame, row_bytes: int) -> DataFrame:
    """side, marked for broadcast if its rows, of row_bytes at most, are below BROADCAST_BYTES; they are counted up to that."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def renamed(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ..., so that columns of any name can be carried beside others."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. Offsets begin at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0) if len(offsets) else np.zeros(1, np.int64)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row has a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_rows(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    data, at = string_buffers(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 8 + 5
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, n + n // 8)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps_ = np.full(size, base & _MASK, np.uint64)
            steps_[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps_)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: each bit of the result depends on each bit of h."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RollingHash:
    """64-bit hashes of any ranges of one array of bytes or 64-bit symbols, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        symbols = _BYTE[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64)) | np.uint64(1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(symbols * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in the bytes, and for each row where its words begin (one more at the end)."""
    ink = ~white(data)
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    at = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    first[at] = ink[at]
    last[at - 1] = ink[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, prepare: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of rows: 64-bit hashes of the words, and for each row where its words begin (one more at the end).

    A row of several STEP_BYTES is hashed in pieces that end at white space, so that only its hashes are held at once.
    """
    for i, j in steps(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * STEP_BYTES:
            part = prepare(data[a:b])
            starts, ends, first = words_of(part, offsets[i : j + 1] - a)
            yield RollingHash(part).of(starts, ends) if len(starts) else np.zeros(0, np.uint64), first
            continue
        hashes, cuts = [], white_cuts(data, a, b)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            part = prepare(data[x:y])
            starts, ends, _ = words_of(part, np.array([0, y - x]))
            hashes.append(RollingHash(part).of(starts, ends))
        words = np.concatenate(hashes)
        yield words, np.array([0, len(words)])


def white_cuts(data: np.ndarray, a: int, b: int, limit: int = STEP_BYTES) -> list[int]:
    """Places from a to b, each but the ends at white space that follows a visible ASCII character, about limit bytes apart."""
    cuts, at = [a], a + limit
    while at < b:
        near = data[at - 1 : min(at + limit, b)]
        here = np.flatnonzero(white(near[1:]) & (near[:-1] > 32) & (near[:-1] < 127))
        if len(here):
            cuts.append(at + int(here[0]))
            at = cuts[-1] + limit
        else:
            at += limit
    return [*cuts, b]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow(); after each task the worker, which lives on for others, gives free memory back to the system."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return task


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def id_ranges(docs: DataFrame) -> list[int]:
    """Ascending upper bounds (inclusive) that cut the ids of docs (doc_id, _text) into ranges of about RANGE_BYTES of text; the last range is open.

    Up to the session's parallelism ranges may be smaller. Bounds come from ids chosen by their hash, IDS_PER_RANGE for
    a range; they only deal rows out, so no result depends on them.
    """
    size, count = docs.agg(F.sum(F.octet_length("_text")), F.count("doc_id")).first()
    size = size or 0
    n = max(math.ceil(size / RANGE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / LEAST_RANGE_BYTES)))
    n = min(MOST_RANGES, max(1, n))
    if n == 1 or not count:
        return []
    some = docs.select("doc_id").filter("doc_id IS NOT NULL").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.lit(min(1.0, IDS_PER_RANGE * n / count) * (1 << 30)))
    ids = some.agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # about IDS_PER_RANGE * MOST_RANGES of them at most
    place = lambda k: F.floor(k * F.size("ids") / n).cast("int") + 1
    cuts = ids.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.try_element_at("ids", place(k)))).first()[0]
    return sorted({c for c in cuts if c is not None})


def range_of(ident: Column, cuts: list[int]) -> Column:
    """Number of the range of an id: in two steps over a square root of the cuts each; a null id is in range 0."""
    if not cuts:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(cuts)))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    coarse = F.size(F.filter(F.lit([r[-1] for r in rows]), lambda c: c < ident))
    table = F.array(*[F.lit(r) for r in rows])
    fine = F.size(F.filter(F.coalesce(F.get(table, coarse), F.lit([]).cast("array<bigint>")), lambda c: c < ident))
    return F.when(ident.isNull(), F.lit(0)).otherwise((coarse * width + fine).cast("int"))


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark deletes the shuffle files of steps that are done."""
    gc.collect()
    spark._jvm.System.gc()
