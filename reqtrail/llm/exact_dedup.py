"""Exact dedup: Patricia tries over length-and-content-hash partitions own each distinct text.

Every text loses its white space ([\\x20\\x09-\\x0D]) first. A first trie in each input partition keeps one
copy of each distinct text, so a hot text is shuffled at most once per input partition; the copies then go to
partitions by (length, SHA-256), where a second trie takes the full byte strings and its terminals keep the
best identifier (most code points in the original, then smallest id). Tries of more than a set number of bytes
spill by subtree: the strings behind one prefix go to a file in the shared folder, which is read back into a trie of
its own, and that may spill subtrees in turn.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SALTS, WHITE, byte_rows, renamed, salted_left_join, scratch, tidy

#: Bytes that a trie holds in memory before subtrees go to files, and bytes of a node besides its label.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400


class Patricia:
    """Compressed radix trie from byte strings to the best of the owners inserted for them.

    An owner is (code points, id): more code points win, then the smaller id; a null id loses to any other.
    A node is [label, owner or None, count, children by first byte, file or None]; what comes below a node with a
    file goes to it. files makes an empty one; without it nothing spills. floor is the depth to which all strings of
    this trie are known to agree.
    """

    def __init__(self, limit: int = TRIE_BYTES, files: Callable[[], Spill] | None = None, floor: int = 0):
        self.root: list = [b"", None, 0, {}, None]
        self.limit, self.held, self.files, self.floor = limit, 0, files, floor
        self.patience = limit

    @staticmethod
    def better(a: tuple, b: tuple) -> tuple:
        key = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0)
        return a if b is None or key(a) <= key(b) else b

    def insert(self, text: bytes, owner: tuple, count: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node[4] is not None:
                node[4].put((text, owner, count))
                return
            if at == len(text):
                node[1], node[2] = self.better(owner, node[1]), node[2] + count
                return
            child = node[3].get(text[at])
            if child is None:
                node[3][text[at]] = [text[at:], owner, count, {}, None]
                self.held += len(text) - at + NODE_BYTES
                if self.files is not None and self.held > self.patience:
                    self.spill()
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = len(os.path.commonprefix([label, text[at : at + len(label)]]))
            node[3][text[at]] = upper = [label[:shared], None, 0, {label[shared]: child}, None]
            child[0] = label[shared:]
            self.held += NODE_BYTES
            node, at = upper, at + shared

    def spill(self) -> None:
        """Send to files the deepest subtree that has half of what is held, or where none has the largest ones until half is gone."""
        sizes: dict[int, int] = {}
        order = [self.root]
        for node in order:
            order.extend(node[3].values())
        for node in reversed(order):
            sizes[id(node)] = len(node[0]) + NODE_BYTES + sum(sizes[id(c)] for c in node[3].values())
        node, path = self.root, b""
        while node[3]:
            child = max(node[3].values(), key=lambda c: sizes[id(c)])
            if 2 * sizes[id(child)] < self.held:
                break
            node, path = child, path + child[0]
        chosen = [(node, path)]
        if len(path) <= self.floor:
            chosen = [(c, path + c[0]) for c in sorted(node[3].values(), key=lambda c: -sizes[id(c)])]
        for node, path in chosen:
            if self.held <= self.limit // 2:
                break
            if node[4] is None:
                out = self.files()
                for row in self.walk(node, path):
                    out.put(row)
                out.floor = len(path)
                node[1:] = [None, 0, {}, out]
                self.held -= sizes[id(node)] - len(node[0]) - NODE_BYTES
        self.patience = max(self.limit, 2 * self.held)  # more only where one string, or labels of what is spilled, exceeds the limit

    @staticmethod
    def walk(node: list, text: bytes) -> Iterator[tuple]:
        todo = [(node, text)]
        while todo:
            node, text = todo.pop()
            if node[1] is not None:
                yield text, node[1], node[2]
            todo.extend((child, text + child[0]) for child in node[3].values())

    def items(self) -> Iterator[tuple]:
        """(text, owner, count) of every distinct text; each spilled subtree is read back into a trie of its own, which may spill deeper ones."""
        spilled, todo = [], [self.root]
        for node in todo:
            todo.extend(node[3].values())
            if node[4] is not None:
                spilled.append(node[4])
        yield from self.walk(self.root, b"")
        self.root = [b"", None, 0, {}, None]
        for out in spilled:
            part = Patricia(self.limit, self.files, out.floor)
            for row in out.rows():
                part.insert(*row)
            out.drop()
            yield from part.items()


class Spill:
    """Rows in a file of a folder that driver and executors share; read once, then deleted."""

    def __init__(self, folder: str):
        self.store, name = pa.fs.FileSystem.from_uri(folder)
        self.store.create_dir(name)
        self.path = f"{name}/trie-{uuid.uuid4().hex}"
        self.out, self.floor = self.store.open_output_stream(self.path, buffer_size=1 << 16), 0

    def put(self, row: tuple) -> None:
        data = pickle.dumps(row)
        self.out.write(len(data).to_bytes(8, "little") + data)

    def rows(self) -> Iterator[tuple]:
        self.out.close()
        with self.store.open_input_stream(self.path, buffer_size=1 << 20) as file:
            while head := file.read(8):
                yield pickle.loads(file.read(int.from_bytes(head, "little")))

    def drop(self) -> None:
        self.store.delete_file(self.path)


def spills(folder: str) -> Callable[[], Spill] | None:
    """Maker of files in the folder; none where Python cannot open its store."""
    try:
        pa.fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return lambda: Spill(folder)


def _members(batches):
    """(id, code points, length and SHA-256 of the normalised text) for each row."""
    for batch in batches:
        texts = [t.translate(None, WHITE) for t in byte_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
            ],
            names=["doc_id", "_points", "_length", "text_sha256"],
        )


OWNED = "_length bigint, text_sha256 string, _text binary, _points bigint, _owner bigint, _count bigint"


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    n, sha, text, points, owner, count = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()), pa.array(points, pa.int64()), pa.array(owner, pa.int64()), pa.array(count, pa.int64())],
        names=["_length", "text_sha256", "_text", "_points", "_owner", "_count"],
    )


def _drain(trie: Patricia, with_text: bool) -> Iterator[pa.RecordBatch]:
    rows, held, seen = [], 0, set()
    for text, (points, owner), count in trie.items():
        sha = hashlib.sha256(text).hexdigest()
        if not with_text:
            if (len(text), sha) in seen:
                raise ValueError(f"two texts of {len(text)} bytes have the SHA-256 {sha}")
            seen.add((len(text), sha))
        rows.append((len(text), sha, text if with_text else None, points, owner, count))
        held += len(text)
        if held > 4 << 20 or len(rows) > 20_000:
            yield _owned(rows)
            rows, held = [], 0
    if rows:
        yield _owned(rows)


def _local(batches):
    """One trie over an input partition, handed on whenever it is full: an upstream combine, so parts need not be merged here."""
    trie = Patricia()
    for batch in batches:
        points = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
        for i, n, text in zip(batch.column(0).to_pylist(), points, byte_rows(batch.column(1)), strict=True):
            trie.insert(text.translate(None, WHITE), (n, i))
            if trie.held > TRIE_BYTES:
                yield from _drain(trie, True)
                trie = Patricia()
    yield from _drain(trie, True)


def _owners(folder: str):
    """One trie over a partition of (length, hash); terminals keep the best identifier and the number of rows."""

    def run(batches):
        trie = Patricia(files=spills(folder))
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (2, 3, 4, 5)]
            for text, points, owner, count in zip(*cols, strict=True):
                trie.insert(text, (points, owner), count)
        yield from _drain(trie, False)

    return run


def _owner_table(docs: DataFrame) -> DataFrame:
    """Of docs (doc_id, _text), for each text that several rows have: _length, text_sha256, _keep, _count."""
    return (
        docs.mapInArrow(tidy(_local), OWNED)
        .repartition("_length", "text_sha256")
        .mapInArrow(tidy(_owners(scratch(docs.sparkSession) + "/spill")), OWNED)
        .filter("_count > 1")
        .select("_length", "text_sha256", F.col("_owner").alias("_keep"), "_count")
    )


def duplicate_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so all empty and blank texts are one group. Of rows with as many
    code points a null id comes after every other. Rows that repeat an id are told apart by nothing: each has kept as its id is
    keep_id and each counts in group_size. An empty table gives no rows; columns other than the two are ignored.
    """
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    members = docs.mapInArrow(tidy(_members), "doc_id bigint, _points bigint, _length bigint, text_sha256 string")
    joined = salted_left_join(members, _owner_table(docs), ["_length", "text_sha256"], SALTS)
    keep = F.when(F.col("_count").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_count", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with exactly one row of each text, white space aside; columns and whole texts as they are.

    It is a row of the owner's id as in duplicate_groups(). Where several rows of a text have that id, or none has
    an id, it is the one with the most code points, then the least text.
    """
    plain, at = renamed(docs), docs.columns.index(text)
    row = plain.select(F.col(f"c{docs.columns.index(ident)}").cast("bigint").alias("_id"), "*")
    added = T.StructType.fromDDL("_points bigint, _length bigint, text_sha256 string")
    names = [*row.columns, *added.names]

    def keyed(batches):
        for batch in batches:
            for key in _members([pa.RecordBatch.from_arrays([batch.column(0), batch.column(at + 1)], names=["doc_id", "_text"])]):
                yield pa.RecordBatch.from_arrays([*batch.columns, *key.columns[1:]], names=names)

    owners = _owner_table(row.select(F.col("_id").alias("doc_id"), F.col(f"c{at}").alias("_text")))
    joined = salted_left_join(row.mapInArrow(tidy(keyed), T.StructType([*row.schema.fields, *added.fields])), owners, ["_length", "text_sha256"], SALTS)
    of_owner = joined.filter(F.col("_count").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    # One row of each text; a hot text is cut to one row in each partition before the shuffle.
    best = Window.partitionBy("_length", "text_sha256").orderBy(F.desc("_points"), f"c{at}")
    return of_owner.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select(*plain.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
