"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

Documents are put into ascending id order by ranges of ids, encoded, and cut into independent blocks of whole
documents. A block is one binary value: a header, its documents' ids and lengths, a checkpoint (the bit offset) every
so many tokens, and the bit stream. One table lookup decodes a token; all stretches between checkpoints are decoded in
step. The code book is one length for each id.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_below, discard, id_ranges, materialise, range_of, release, string_buffers, table_path, tidy
from .pretokens import Dictionary, take

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Longest code in bits, tokens in a block (a longer document is a block of its own), tokens from checkpoint to checkpoint.
LIMIT, BLOCK_TOKENS, CHECKPOINT = 18, 1 << 19, 512
#: Pieces that are joined for the library, and texts in one call of it.
JOINED, BATCH = 500, 64
#: Bytes of a row of the blocks' starts in a table that is broadcast below common.BROADCAST_BYTES.
START_BYTES = 64
MAGIC = b"THC1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; ids that do not occur get 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    level, kinds = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        kinds.append(order < len(leaves))
    take_, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(kinds):
        n = int(leaf[:take_].sum())
        lengths[:n] += 1
        take_ = 2 * (take_ - n)
    out[used] = lengths
    return out


class Code:
    """Canonical codes: ascending by length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        self.codes = np.zeros(len(lengths), np.uint64)
        self.table = np.zeros(1 << LIMIT, np.uint32)
        size = self.lengths[used]
        spans = (1 << (LIMIT - size)).astype(np.int64)
        first = np.cumsum(spans) - spans
        self.codes[used] = (first >> (LIMIT - size)).astype(np.uint64)
        self.table[: int(spans.sum())] = np.repeat(((used << 5) | size).astype(np.uint32), spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream of ids, and the bit offset of each checkpoint."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        size = self.lengths[ids]
        if size.min() < 1:
            raise ValueError("an id has no code")
        end = np.cumsum(size)
        at = end - size
        word, code = at >> 6, self.codes[ids]
        room = 64 - (at & 63) - size
        fits = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
        words[word[first]] = np.bitwise_or.reduceat(fits, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at[::CHECKPOINT]

    def unpack(self, stream: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """n ids from a bit stream with its checkpoints."""
        data = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((len(marks), CHECKPOINT), np.uint32)
        at, last = marks.astype(np.int64).copy(), len(window) - 1
        for k in range(CHECKPOINT):
            peek = (window[np.minimum(at >> 3, last)] >> (32 - LIMIT - (at & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
            entry = self.table[peek]
            out[:, k] = entry >> 5
            at += entry & 31
        return out.ravel()[:n]


def write_block(code: Code, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    stream, marks = code.pack(ids)
    parts = [doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(), marks.astype("<u8").tobytes(), stream]
    return MAGIC + np.array([len(ids), len(doc_ids), len(marks)], "<u8").tobytes() + b"".join(parts)


def read_block(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are null, tokens of each document, and all ids."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n, docs, marks = (int(x) for x in np.frombuffer(block, "<u8", 3, 4))
    at = 28
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    nulls = np.frombuffer(block, np.uint8, docs, at + 8 * docs).astype(bool)
    counts = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    places = np.frombuffer(block, "<u8", marks, at + 13 * docs)
    return doc_ids, nulls, counts, code.unpack(block[at + 13 * docs + 8 * marks :], places, n)


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_tokens(path: str) -> tuple[bytes, ...]:
    """Strings of the tokenizer's added tokens, which a text is split at first."""
    added = [t for t in tokenizer(path).get_added_tokens_decoder().values() if t.content]
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("an added token takes white space along or must be a word")
    return tuple(t.content.encode() for t in added)


def _apart(piece: bytes) -> bool:
    """Whether a piece is a blank before a visible character: such pieces, joined, are cut into the same pieces again."""
    return len(piece) > 1 and piece[0] == 32 and (32 < piece[1] < 127 or 0xC3 <= piece[1] < 0xE0)


def encode_pieces(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids that the library gives for each piece, all joined, and how many each has.

    Pieces that stay apart when joined go to the library JOINED at a time, which costs it less; its word numbers say
    whose the ids are.
    """
    library = tokenizer(path)
    apart = [k for k, t in enumerate(texts) if _apart(t)]
    groups = [apart[k : k + JOINED] for k in range(0, len(apart), JOINED)] + [[k] for k, t in enumerate(texts) if not _apart(t)]
    counts, found = np.zeros(len(texts), np.int64), []
    for k in range(0, len(groups), BATCH):
        some = groups[k : k + BATCH]
        encoded = library.encode_batch([b"".join([texts[j] for j in g]).decode() for g in some], add_special_tokens=False)
        for g, x in zip(some, encoded, strict=True):
            if len(g) > 1:
                counts[g] = np.bincount(x.word_ids, minlength=len(g))  # raises an error if there are more words than pieces
            else:
                counts[g[0]] = len(x.ids)
            found.append(np.array(x.ids, np.uint32))
    order = np.concatenate([np.array(g, np.int64) for g in groups]) if groups else np.zeros(0, np.int64)
    if len(order) and (counts == 0).any():
        raise ValueError("joined pieces were not cut apart again")
    ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
    # From the order of the groups back to that of the pieces.
    sizes = counts[order]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    out = np.zeros(len(ids), np.uint32)
    out[np.repeat(at[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
    return out, counts


@cache
def remembered(path: str) -> Dictionary:
    """The pieces that this worker process has encoded, for all its tasks; bounded."""
    return Dictionary(lambda texts: encode_pieces(path, texts), whole=added_tokens(path))


RAW = "_range int, block int, doc_ids binary, nulls binary, counts binary, ids binary"


def _raw(batches, path: str, end_id: int):
    """Blocks of ids of rows that come in order of (range, id); last a row without a range, with the count of each id."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    words = remembered(path)
    totals = np.zeros(0, np.int64)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in RAW.split(", ")]
    row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, kinds, strict=True)], names=names)
    held: list[tuple] = []
    now, number, size = None, 0, 0

    def block():
        d, z, c, i = (np.concatenate(x) for x in zip(*held, strict=True))
        return row(now, number, d.astype("<i8").tobytes(), z.astype(np.uint8).tobytes(), c.astype("<u4").tobytes(), i.astype("<u4" if i.max() > 0xFFFF else "<u2").tobytes() if len(i) else b"")

    for batch in batches:
        ranges = np.asarray(batch.column(0))
        nulls = np.asarray(batch.column(1).is_null())
        docs = np.asarray(batch.column(1).fill_null(0))
        data, offsets = string_buffers(batch.column(2))
        for i, j, rows, first in words.blocks(data, offsets):
            ids, sizes = take(words.ids, words.at, rows)
            cut = np.concatenate([[0], np.cumsum(sizes)])[first]
            ids = np.insert(ids, cut[1:], end_id)
            counts = np.diff(cut) + 1
            if len(ids):
                seen = np.bincount(ids)
                if len(seen) > len(totals):
                    seen[: len(totals)] += totals
                    totals = seen
                else:
                    totals[: len(seen)] += seen
            ends = np.cumsum(counts)
            k = i
            while k < j:
                if ranges[k] != now or size >= BLOCK_TOKENS:
                    if held:
                        yield block()
                    number = number + 1 if ranges[k] == now else 0
                    now, held, size = int(ranges[k]), [], 0
                # As many rows as are of this range and still fit, one at least.
                base = ends[k - i] - counts[k - i]
                stop = int(np.searchsorted(ends, base + BLOCK_TOKENS - size, "right")) + i
                other = np.flatnonzero(ranges[k:j] != now)
                stop = max(k + 1, min(stop, j, k + int(other[0]) if len(other) else j))
                held.append((docs[k:stop], nulls[k:stop], counts[k - i : stop - i], ids[base : ends[stop - 1 - i]]))
                size += int(ends[stop - 1 - i] - base)
                if stop < j and ranges[stop] == now:
                    size = max(size, BLOCK_TOKENS)
                k = stop
    if held:
        yield block()
    yield row(None, None, None, None, None, totals.astype("<i8").tobytes())


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write ids to files below path: `book` (a length for each id) and `blocks`.

    Null text counts as empty: such a document has the end id alone. Order is ascending by doc_id, null ids first;
    rows that repeat an id are ordered by text. Strings of added tokens in a text get those tokens' ids, as the library
    gives them. Other columns are ignored. Without rows there are no blocks and an empty book.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    cuts = id_ranges(docs)
    rows = docs.select(range_of(F.col("doc_id"), cuts).alias("_range"), "doc_id", "_text").repartitionById(len(cuts) + 1, "_range")
    rows = rows.sortWithinPartitions("_range", F.col("doc_id").asc_nulls_first(), "_text")
    raw = materialise(rows.mapInArrow(tidy(lambda it: _raw(it, tokenizer_path, end_id)), RAW), "token-ids")
    del rows
    release(spark)

    def summed(batches):
        totals = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                more = np.frombuffer(x, "<i8")
                n = max(len(more), len(totals))
                totals = np.pad(totals, (0, n - len(totals))) + np.pad(more, (0, n - len(more)))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], names=["id", "n"])

    counts = raw.filter("_range IS NULL").select("ids").mapInArrow(tidy(summed), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    table = np.zeros(max((r[0] for r in counts), default=-1) + 1, np.int64)
    for i, n in counts:
        table[i] = n
    lengths = code_lengths(table).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/book")

    def pack(batches):
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for r in batch.to_pylist():
                counts_ = np.frombuffer(r["counts"], "<u4")
                n = int(counts_.sum())
                ids = np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * n else "<u4")
                data = write_block(code, np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8), counts_, ids)
                yield pa.RecordBatch.from_arrays([pa.array([r["_range"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "n_tokens", "data"])

    raw.filter("_range IS NOT NULL").mapInArrow(tidy(pack), "shard int, block int, n_tokens bigint, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(raw)


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Decode the files below path: doc_id, start, n_tokens, and ids (binary, little-endian 32 bits) or ids_crc32 for digests.

    Rows are those that were written: null and repeated ids come back as such. A file set without blocks gives no rows.
    """
    lengths = bytes(spark.read.parquet(f"{path}/book").first()[0])
    blocks = spark.read.parquet(f"{path}/blocks")
    # Starts: ranges are summed first, at most MOST_RANGES rows, then the blocks in each range.
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    shards = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("_in")).join(shards, "shard")
    starts = materialise(starts.select("shard", "block", (F.col("_base") + F.col("_in")).alias("_start")), "starts")
    placed = blocks.join(broadcast_below(starts, START_BYTES), ["shard", "block"])

    def unpack(batches):
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, nulls, counts, ids = read_block(code, data)
                cut = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
                whole, edges = ids.astype("<u4").tobytes(), (4 * cut).tolist()
                each = [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digests else pa.array(each, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(start + cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()), last], names=["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digests else "ids"
    return placed.select("_start", "data").mapInArrow(tidy(unpack), f"doc_id bigint, start bigint, n_tokens bigint, {name} {'bigint' if digests else 'binary'}")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write documents' ids and read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = table_path(docs.sparkSession, "tokens")
    write(docs, path)
    return read(docs.sparkSession, path, digests=True)
