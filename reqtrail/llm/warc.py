"""WARC archives with a two-level capture index.

Archives are WARC/1.1 files written by Spark's text writer: a row is a record without its closing CRLF CRLF, which
the writer adds as its line separator, so they go to any store that Spark writes. The index is a line for each
record, sorted by reversed-host URL key and cut into compressed blocks, one after the other in files; a sparse
directory has the first and last key of each block and the bytes where it lies. A lookup searches the directory, reads
the bytes of a few blocks, searches those, and reads the bytes of the records that their lines name. All such reads
are seeks in files that executors open by URI; of a store that only Spark opens, whole files are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, broadcast_below, byte_rows, discard, materialise, salted_left_join, table_path, tidy

#: Bytes of an archive by the mean record, and index lines in one compressed block.
ARCHIVE_BYTES, BLOCK_LINES = 256 << 20, 3000
#: Bytes that one read takes at most where ranges touch, and bytes that a scan holds besides the record at hand.
READ_BYTES = 8 << 20
#: Bytes of a file whose ranges one task reads.
STRETCH = 64 << 20
#: Bytes of a row of winners in a table that is broadcast below common.BROADCAST_BYTES.
WINNER_BYTES = 256
CRLF = b"\r\n"
END = CRLF * 2


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query in lower case; without a host, the URL itself."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return url
    tail = parts.path or "/"
    if parts.query:
        tail += "?" + parts.query
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail.lower()


def _digests(batches):
    for batch in batches:
        digests = [digest_of(p) for p in byte_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())], names=["page_id", "_digest", "_bytes"])


def _digested(batches):
    for batch in batches:
        digests = [digest_of(p) for p in byte_rows(batch.column(2))]
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), sizes], names=["page_id", "url", "html", "_digest", "_bytes"])


def _field(text: str | None) -> bytes:
    """A header's value: control characters would end the header, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text or "").encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: tuple | None) -> bytes:
    """A response record, or for original = (page_id, url) a revisit record with the full payload's length and digest."""
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\0{url}\0{digest}")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if original else b"response"), b"WARC-Record-ID: <urn:uuid:%s>" % str(ident).encode(), b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Target-URI: " + _field(url)]
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Page-Id: " + (b"" if page_id is None else b"%d" % page_id), b"X-Payload-Length: %d" % len(payload)]
    if original:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To-Target-URI: " + _field(original[1]), b"X-Refers-To-Page-Id: %d" % original[0]]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if original else payload)
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return CRLF.join(head) + END + body


def _records(batches):
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)]
        rows = [record(i, u, p, d, None if w is None or w == i else (w, wu)) for p, i, u, d, w, wu in zip(byte_rows(batch.column(2)), *cols, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int | None = None) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives below path.

    Of records whose payloads are equal and have at least least_bytes bytes, that with the largest page_id is the
    response and the others revisit it; equal is the same length and SHA-1. Null html is an empty payload, null url an
    empty target. A row with a null page_id is always a response, as are rows that repeat the largest page_id of their
    payload. An empty table writes no record; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    key = ["_digest", "_bytes"]
    best = (
        pages.select("page_id", "html").mapInArrow(tidy(_digests), "page_id bigint, _digest string, _bytes bigint")
        .filter(F.col("_bytes") >= least_bytes)
        .groupBy(*key).agg(F.count("*").alias("_n"), F.max("page_id").alias("_winner"))
        .filter("_n > 1 AND _winner IS NOT NULL").drop("_n")
    )
    winners = pages.select("page_id", F.col("url").alias("_winner_url")).join(best.select(F.col("_winner").alias("page_id")), "page_id", "left_semi").groupBy("page_id").agg(F.min("_winner_url").alias("_winner_url"))
    best = best.join(winners.withColumnRenamed("page_id", "_winner"), "_winner")
    best = materialise(best.select(*key, "_winner", "_winner_url"), "winners")
    rows = pages.mapInArrow(tidy(_digested), "page_id bigint, url string, html string, _digest string, _bytes bigint")
    side = broadcast_below(best, WINNER_BYTES)
    rows = salted_left_join(rows, best, key, SALTS) if side is best else rows.join(side, key, "left")
    rows = rows.withColumn("_winner", F.when(F.col("page_id").isNotNull(), F.col("_winner")))
    made = rows.select("page_id", "url", "html", "_digest", "_winner", "_winner_url").mapInArrow(tidy(_records), "value binary")
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    records = max(1, int((archive_bytes or ARCHIVE_BYTES) / (mean + 600)))  # about 600 bytes of headers
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records).text(f"{path}/archives")
    discard(best)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at a byte of an archive."""
    split = data.index(END, at)
    lines = data[at:split].split(CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record at byte {at}")
    head = {k.strip().decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    first = split + 4
    last = first + int(head["content-length"])
    if data[last : last + 4] != END:
        raise ValueError(f"the record at byte {at} does not end where its length says")
    return head, data[first:last], last + 4


def opened(path: str) -> pa.NativeFile:
    """The file at a URI, for reads at any place."""
    store, name = pa.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Reader:
    """Reads at places of one file after the other; bytes_read counts what it has asked for."""

    def __init__(self):
        self.path, self.file, self.bytes_read = None, None, 0

    def use(self, path: str, content: bytes | None = None) -> None:
        if path != self.path:
            self.close()
            self.path, self.file = path, opened(path) if content is None else pa.BufferReader(content)

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        self.bytes_read += len(data)
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def scanned(reader: Reader, size: int, whole) -> Iterator[tuple]:
    """For each item of a file from its start: place and whole(data, at) -> (item, end), holding little more than an item.

    whole raises an IndexError where data ends too early; more is read then.
    """
    base, data, at = 0, b"", 0
    while base + at < size:
        try:
            item, end = whole(data, at)
        except IndexError:
            if base + len(data) >= size:
                raise ValueError(f"{reader.path} ends in the middle of a record") from None
            data, base, at = data[at:], base + at, 0
            data += reader.at(base + len(data), max(READ_BYTES, len(data)))
            continue
        yield base + at, item, end - at
        at = end


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Headers and end of a record, of which data may hold only a part."""
    if data.find(END, at) < 0:
        raise IndexError
    split = data.index(END, at)
    length = int(next(x[15:] for x in data[at:split].split(CRLF) if x[:15].lower() == b"content-length:"))
    if split + 8 + length > len(data):
        raise IndexError
    head, _, end = parse(data, at)
    return head, end


def _captures(batches):
    """A row (key, line) for each record of archives, which are read through in steps."""
    reader = Reader()
    for batch in batches:
        held = batch.to_pylist()
        for row in held:
            reader.use(row["path"], row.get("content"))
            keys, lines = [], []
            for at, head, length in scanned(reader, row["length"], _record_at):
                keys.append(url_key(head["warc-target-uri"]))
                lines.append(json.dumps([keys[-1], row["path"], at, length]))
                if len(lines) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])
                    keys, lines = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])
    reader.close()


def _packed(lines: list[str]) -> bytes:
    """A block: a line of JSON with its first key, last key, lines and bytes, then the compressed lines."""
    block = zlib.compress("\n".join(lines).encode())
    return json.dumps([json.loads(lines[0])[0], json.loads(lines[-1])[0], len(lines), len(block)]).encode() + b"\n" + block


def _blocks(batches):
    """Blocks of sorted lines, as rows of the text writer, which ends each in a line feed."""
    lines = []
    for batch in batches:
        lines += batch.column(0).to_pylist()
        full = [lines[k : k + BLOCK_LINES] for k in range(0, len(lines) - BLOCK_LINES + 1, BLOCK_LINES)]
        lines = lines[len(full) * BLOCK_LINES :]
        yield pa.RecordBatch.from_arrays([pa.array([_packed(x) for x in full], pa.binary())], names=["value"])
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(lines)], pa.binary())], names=["value"])


def _block_at(data: bytes, at: int) -> tuple[list, int]:
    head = data[at : data.find(b"\n", at) + 1]
    if not head:
        raise IndexError
    first, last, _, size = json.loads(head)
    end = at + len(head) + size + 1
    if end > len(data):
        raise IndexError
    return [first, last, len(head)], end


PLACE = "first_key string, last_key string, path string, offset bigint, length bigint"


def _places(batches):
    """Directory rows of index files: the keys of each block and where its compressed lines lie."""
    reader = Reader()
    for batch in batches:
        for row in batch.to_pylist():
            reader.use(row["path"], row.get("content"))
            found = [(a, b, row["path"], at + skip, length - skip - 1) for at, (a, b, skip), length in scanned(reader, row["length"], _block_at)]
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=[x.split()[0] for x in PLACE.split(", ")])
    reader.close()


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files that Spark wrote to a folder, dealt one to a task; with content where only Spark can open them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    if not reachable(folder):
        return found.select("path", "length", "content")
    names = found.select("path", "length")
    return names.repartition(max(1, min(names.count(), 100_000)), "path")


def reachable(folder: str) -> bool:
    """Whether Python can open files by the folder's URI."""
    try:
        pa.fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def write_index(spark: SparkSession, path: str) -> None:
    """Read the archives below path and write their index: sorted lines in blocks, and the directory of the blocks."""
    lines = files(spark, f"{path}/archives").mapInArrow(tidy(_captures), "key string, line string")
    ordered = lines.repartitionByRange("key", "line").sortWithinPartitions("key", "line").select("line")
    ordered.mapInArrow(tidy(_blocks), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/index")
    directory = files(spark, f"{path}/index").mapInArrow(tidy(_places), PLACE)
    directory.repartitionByRange("first_key").sortWithinPartitions("first_key").write.parquet(f"{path}/directory")


def at_places(spark: SparkSession, folder: str, places: DataFrame, use, schema: str) -> DataFrame:
    """use(batches of bytes) over the bytes of places (path, offset, length) of files in a folder.

    Places are dealt by stretches of their files and read in order; those that touch are read at once.
    """
    near = places.withColumn("_stretch", F.floor(F.col("offset") / STRETCH)).repartition("path", "_stretch").sortWithinPartitions("path", "offset")
    if not reachable(folder):
        whole = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
        near = whole.join(near.groupBy("path", "_stretch").agg(F.collect_list(F.struct("offset", "length")).alias("_at")), "path")

        def cut(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield [row["content"][x["offset"] : x["offset"] + x["length"]] for x in row["_at"]]

        return near.select("content", "_at").mapInArrow(tidy(lambda batches: use(cut(batches))), schema)
    return near.select("path", "offset", "length").mapInArrow(tidy(lambda batches: use(ranges(batches))), schema)


def ranges(batches, reader: Reader | None = None) -> Iterator[list[bytes]]:
    """The bytes of rows (path, offset, length), in lists of about READ_BYTES."""
    reader = reader or Reader()
    for batch in batches:
        paths, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
        k = 0
        while k < len(paths):
            j, end = k + 1, offsets[k] + lengths[k]
            while j < len(paths) and paths[j] == paths[k] and offsets[j] == end and end + lengths[j] - offsets[k] <= READ_BYTES:
                end += lengths[j]
                j += 1
            reader.use(paths[k])
            data = reader.at(offsets[k], end - offsets[k])
            yield [data[a - offsets[k] : a - offsets[k] + n] for a, n in zip(offsets[k:j], lengths[k:j], strict=True)]
            k = j
    reader.close()


LINE = "path string, offset bigint, length bigint"


def _lines(blocks: Iterable[list[bytes]], keys: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The lines of compressed index blocks: all, or those of some keys by binary search."""
    for some in blocks:
        for block in some:
            rows = [json.loads(x) for x in zlib.decompress(block).decode().split("\n")]
            if keys is not None:
                names = [r[0] for r in rows]
                rows = [r for k in keys[bisect.bisect_left(keys, names[0]) : bisect.bisect_right(keys, names[-1])] for r in rows[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()))], names=["path", "offset", "length"])


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _parsed(records: Iterable[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of records; payloads of responses are held against their lengths and digests."""
    whole = lambda v: int(v) if v else None
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for some in records:
        rows = []
        for data in some:
            head, block, end = parse(data)
            if end != len(data):
                raise ValueError("an index line has a wrong length")
            payload, kind, size = block.partition(END)[2], head["warc-type"], int(head["x-payload-length"])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                raise ValueError(f"a payload does not have its digest {digest}")
            rows.append((whole(head["x-page-id"]), size, digest, kind, whole(head.get("x-refers-to-page-id")), head["warc-target-uri"], payload if kind == "response" else None))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def read_records(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """Read records back through the index: all of them, or those of lines (path, offset, length).

    A revisit has no payload of its own (null), but its payload's full length and digest. No archives give no rows;
    lines that come again give their record again.
    """
    if lines is None:
        lines = at_places(spark, f"{path}/index", spark.read.parquet(f"{path}/directory").select("path", "offset", "length"), _lines, LINE)
    return at_places(spark, f"{path}/archives", lines, _parsed, READ)


def lookup(spark: SparkSession, path: str, urls: Iterable[str | None]) -> DataFrame:
    """Records of some URLs: binary searches in the directory and in the blocks that it names give the byte ranges to read.

    A URL that no record has gives no row, and one that is asked for twice counts once; null is the empty URL.
    """
    keys = sorted({url_key(u) for u in urls})

    def search(batches):
        for batch in batches:
            first, last = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = [bisect.bisect_left(keys, a) < bisect.bisect_right(keys, b) for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[2:], names=["path", "offset", "length"]).filter(pa.array(hit, pa.bool_()))

    directory = spark.read.parquet(f"{path}/directory")
    if keys:  # Parquet's own least and greatest keys leave out most row groups
        directory = directory.filter((F.col("first_key") <= keys[-1]) & (F.col("last_key") >= keys[0]))
    blocks = directory.mapInArrow(tidy(search), LINE)
    return read_records(spark, path, at_places(spark, f"{path}/index", blocks, lambda found: _lines(found, keys), LINE))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive pages, index the archives, and read all records back through the index.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. See write_archives() for nulls and
    repeated ids; an empty table gives no rows; other columns are ignored. The files stay for the caller, in a folder
    `warc-...` of the shared one.
    """
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    write_index(spark, path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS digest,
        max(page_id) OVER (PARTITION BY html) AS winner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to FROM d
"""
