"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Each text's distinct five-word shingles are hashed once; the K smallest hashes are its sketch. Texts with equal
   sets are one node.
2. Inverted lists of retained values that several nodes share give candidates. Two sets with Jaccard 0.75 share T
   or more of their sketches' values (a miss at exactly 0.75 has probability 4e-7), so a node stays only in the lists
   of its rarest shared values, all but T - 1 of them: common passages drop out by themselves.
3. Near copies share most of their lists. Lists with the same head, the member with the least hash of its name, are
   one family, so that a pair is met a few times, not once for each value that it shares; every two nodes of a list
   are in one family with it.
4. A family's full sets go to tasks by blocks of bounded bytes. In a task the union sketch filters pairs, exact Jaccard
   on the full sets verifies those that pass, and only a spanning forest of the verified links comes out, so rows
   grow with the members, not with their pairs. Each block holds the head as well. Families of more than one block
   are finished by pairs of blocks: members outside the family's largest component against all members.
5. Links are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from .common import LARGEST, SALTS, broadcast_below, discard, lowered, materialise, mixed, release, renamed, salted_left_join, string_buffers, tidy, word_hashes
from .components import components

WORDS = 5
#: Similarity in percent; retained hashes; shared retained values that two similar sets have at least.
PERCENT, K, T = 75, 64, 30
#: Bytes of members in a block: eight for a hash and ROW_BYTES for a member.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 2048
#: Rows whose overlaps with all others are counted at once.
TILE = 256
#: Bytes of a row in tables that are broadcast below common.BROADCAST_BYTES.
NODE_BYTES = 96
_FACTOR = np.random.default_rng(75).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles; a long row's words are hashed piece by piece."""
    for words, first in word_hashes(data, offsets, lowered):
        n = max(0, len(words) - WORDS + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(WORDS):
            runs += words[k : k + n] * _FACTOR[k]
        runs = mixed(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(runs[a : b - WORDS + 1])
            elif b > a:
                yield mixed((words[a:b] * _FACTOR[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), pa.array(flat))


def _sketches(text: int, names: list[str]):
    """The first columns of each batch, of those names, with the size, digest and sketch of the set of column `text`."""

    def run(batches):
        for batch in batches:
            sizes, digests, values = [], [], []
            for s in shingle_sets(*string_buffers(batch.column(text))):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                values.append(s[:K])
            digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            held = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*held, pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(values)], names=[*names, "n", "d1", "d2", "sketch"])

    return run


def _sets(batches):
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(*string_buffers(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


class Sparse:
    """Sets as rows of numbered values; values that only one row has are left out."""

    def __init__(self, rows: list[np.ndarray]):
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[code] > 1
        number = np.cumsum(count > 1) - 1
        self.row, self.code, self.size = owner[keep], number[code[keep]], int((count > 1).sum())
        self.at = np.searchsorted(self.row, np.arange(len(rows) + 1))
        order = np.argsort(self.code, kind="stable")
        self.holders = self.row[order]  # of each value in turn, ascending
        self.first = np.searchsorted(self.code[order], np.arange(self.size + 1))

    def overlaps(self, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Shared values of each of the rows `some` with each of the rows lo to hi.

        Values that many hold are counted by a matrix product, the others holder by holder.
        """
        out = np.zeros((len(some), hi - lo), np.float32)
        sizes = self.at[some + 1] - self.at[some]
        where = np.repeat(np.arange(len(some)), sizes)
        mine = np.repeat(self.at[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        code = self.code[mine]
        held = np.bincount(code, minlength=self.size)
        reach = np.diff(self.first)
        thick = held * reach * 200 > out.size
        wide = np.flatnonzero(thick & (held > 0))
        there = slice(self.at[lo], self.at[hi])
        column = np.full(self.size, -1)
        for k in range(0, len(wide), 2048):
            part = wide[k : k + 2048]
            column[part] = np.arange(len(part))
            a, b = np.zeros((len(some), len(part)), np.float32), np.zeros((hi - lo, len(part)), np.float32)
            c = column[code]
            a[where[c >= 0], c[c >= 0]] = 1
            c = column[self.code[there]]
            b[self.row[there][c >= 0] - lo, c[c >= 0]] = 1
            out += a @ b.T
            column[part] = -1
        thin = np.flatnonzero(~thick[code]) if len(code) else np.zeros(0, np.int64)
        for k in range(0, len(thin), 1 << 16):
            part = thin[k : k + (1 << 16)]
            n = reach[code[part]]
            other = self.holders[np.repeat(self.first[code[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            inside = (other >= lo) & (other < hi)
            cell = np.repeat(where[part], n)[inside] * (hi - lo) + other[inside] - lo
            out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.float32)
        return out


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links a-b to keep so that they join what all of them join, and the labels afterwards.

    Rounds as in Boruvka's method: each label takes its first link to another one.
    """
    kept = [np.zeros(0, np.int64)]
    label = label.copy()
    live = np.arange(len(a))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.unique(np.concatenate(kept)), label
        ends = np.concatenate([label[a[live]], label[b[live]]])
        first = np.full(int(label.max()) + 1, len(live))
        np.minimum.at(first, ends, np.tile(np.arange(len(live)), 2))
        chosen = np.unique(first[first < len(live)])
        kept.append(live[chosen])
        # Labels joined by the chosen links get the least of them.
        x, y = label[a[live[chosen]]], label[b[live[chosen]]]
        up = np.arange(int(label.max()) + 1)
        while True:
            low = np.minimum(up[x], up[y])
            before = up.copy()
            np.minimum.at(up, x, low)
            np.minimum.at(up, y, low)
            up = up[up]
            if (up == before).all():
                break
        label = up[label]


def similar(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a forest of which joins all sets of `left` to those of `right` that are similar and have other labels.

    Sizes and the overlap in the least K values of the union filter; the overlap of the full sets decides.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    sets, size, label, left, right = [sets[k] for k in order.tolist()], size[order], label[order], left[order], right[order]
    _, label = np.unique(label, return_inverse=True)
    sketch = [s[:K] for s in sets]
    few, full = Sparse(sketch), Sparse(sets)
    some = np.flatnonzero(left)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    symmetric = bool((left == right).all())
    for k in range(0, len(some), TILE):
        rows = some[k : k + TILE]
        lo = int(rows[0]) if symmetric else int(np.searchsorted(100 * size, PERCENT * size[rows[0]]))
        hi = int(np.searchsorted(PERCENT * size, 100 * size[rows[-1]], "right"))
        small, large = np.minimum(size[rows][:, None], size[lo:hi]), np.maximum(size[rows][:, None], size[lo:hi])
        ok = right[lo:hi] & (label[rows][:, None] != label[lo:hi]) & (100 * small >= PERCENT * large)
        if not ok.any():
            continue
        # The shared ones of the union's K least values are in both sketches: T or more. Sketches of up to K values are whole sets.
        need = np.where(large <= K, (PERCENT * (small + large) + 99 + PERCENT) // (100 + PERCENT), T)
        ok &= few.overlaps(rows, lo, hi) >= need
        i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(i):
            continue
        near_lo, near_hi = lo + int(j[0]), lo + int(j[-1]) + 1
        shared = full.overlaps(rows[i], near_lo, near_hi)
        both = size[rows[i]][:, None] + size[near_lo:near_hi]
        a, b = np.nonzero(ok[i][:, near_lo - lo : near_hi - lo] & (100 * shared >= PERCENT * (both - shared)))
        a, b = rows[i][a], near_lo + b
        keep, label = forest(a, b, label)
        found_a.append(a[keep])
        found_b.append(b[keep])
    return order[np.concatenate(found_a)], order[np.concatenate(found_b)]


#: side: 0 meets all of its task, 1 meets 2.
MEMBER = "head bigint, block int, other int, side int, node bigint, component bigint, set binary"
LINK = "a bigint, b bigint"


def _linked(batches):
    """Links of each task (head, block, other), whose members come together; a task's members are held at once."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        side, node, component, sets = zip(*held, strict=True)
        side, node = np.array(side), np.array(node, np.int64)
        a, b = similar([np.frombuffer(s, np.uint64) for s in sets], np.array(component, np.int64), side < 2, side != 1)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(7)]
        for head, block, other, *row in zip(*cols, strict=True):
            if (head, block, other) != now:
                if len(held) > 1:
                    yield links(held)
                now, held = (head, block, other), []
            held.append(row)
    if len(held) > 1:
        yield links(held)


def shared_lists(sketches: DataFrame) -> DataFrame:
    """Inverted lists (value, node) of each node's rarest shared values, all but T - 1 of them (fewer for small sets)."""
    values = sketches.select("node", F.size("sketch").cast("short").alias("size"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    rows = values.join(common, "value")
    by_node = Window.partitionBy("node")
    rows = rows.withColumn("rank", F.row_number().over(by_node.orderBy("df", "value"))).withColumn("shared", F.count("*").over(by_node))
    # Sets of up to three quarters of K are whole, and so are those that they can be similar to.
    least = F.when(F.col("size") * 4 <= 3 * K, F.ceil(F.col("size") * PERCENT / 100)).otherwise(T)
    return rows.filter(F.col("rank") <= F.col("shared") - least + 1).select("value", "node")


def families(lists: DataFrame) -> DataFrame:
    """(head, node): for each list of several nodes its members, under the member with the least hash; rows are distinct."""
    heads = lists.groupBy("value").agg(F.min_by("node", F.xxhash64("node")).alias("head"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    return lists.join(heads, "value").select("head", "node").distinct()


def near_links(sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Components (node, component) of nodes (one for each distinct set) whose sets are similar.

    sketches: node, n, sketch. texts gives (node, text) for a table of nodes.
    """
    spark = sketches.sparkSession
    members = materialise(families(shared_lists(sketches)), "members")
    nodes = members.select("node").distinct()
    sets = materialise(texts(nodes).mapInArrow(tidy(_sets), "node bigint, set binary"), "sets")
    release(spark)
    weight = 8 * F.col("n") + ROW_BYTES
    sized = members.join(sketches.select("node", "n"), "node")

    def blocks(rows: DataFrame) -> DataFrame:
        """rows with the number of blocks of their family, and theirs."""
        number = rows.groupBy("head").agg(F.least(F.ceil(F.sum(weight) / BLOCK_BYTES), F.count("*")).cast("int").alias("blocks"))
        dealt = salted_left_join(rows, number.filter("blocks > 1"), ["head"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))

    def linked(tasks: DataFrame) -> DataFrame:
        met = broadcast_below(tasks, NODE_BYTES).join(sets, "node").select([x.split()[0] for x in MEMBER.split(", ")])
        return met.repartition("head", "block", "other").sortWithinPartitions("head", "block", "other").mapInArrow(tidy(_linked), LINK)

    dealt = materialise(blocks(sized), "blocks")
    one = F.lit(0).alias("other"), F.lit(0).alias("side"), "node", F.col("node").alias("component")
    # The head is in every block of its family.
    several = dealt.filter("node = head AND blocks > 1").withColumn("own", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> own")
    links = materialise(linked(dealt.select("head", "block", *one).unionByName(several.select("head", "block", *one))), "links")
    first = components(links)
    release(spark)
    if dealt.filter("blocks > 1").isEmpty():
        discard(members, sets, dealt, links)
        return first

    # Families of several blocks: who is outside the largest component of the family meets all of it, by pairs of blocks.
    placed = dealt.filter("blocks > 1").select("head", "node", "n", "block", "blocks").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed, "placed")
    largest = placed.groupBy("head", "component").agg(F.count("*").alias("m")).groupBy("head").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
    outside = placed.join(largest, "head").filter("component <> main").select("head", "node", "n", "component")
    outside = materialise(blocks(outside), "outside")
    asked = outside.groupBy("head").agg(F.first("blocks").alias("asking"))
    asking = outside.join(placed.select("head", "blocks").distinct().withColumnRenamed("blocks", "all"), "head")
    asking = asking.select("head", "block", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("other"), F.lit(1).alias("side"), "node", "component")
    answering = placed.join(asked, "head").select("head", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("block"), F.col("block").alias("other"), F.lit(2).alias("side"), "node", "component")
    more = materialise(linked(asking.unionByName(answering)), "links")
    out = first
    if more.limit(1).count():
        out = components(links.unionByName(more))
        discard(first)
    discard(members, sets, dealt, links, placed, outside, more)
    return out


def _grouped(rows: DataFrame, texts) -> DataFrame:
    """rows (_row, doc_id, n, d1, d2) with _least, the smallest id of their group, and _first, the row that stays.

    rows come with sketch; texts(heads) gives (node, text) for heads (node, _row). A row with the smallest id stays;
    null ids come last.
    """
    ordinal = F.coalesce("doc_id", F.lit(LARGEST))
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min_by("_row", ordinal).alias("first"), F.count("*").alias("members"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    heads = classes.select("node", F.col("first").alias("_row"))
    sketches = materialise(rows.join(broadcast_below(heads, NODE_BYTES), "_row").select("node", "n", "sketch"), "heads")
    found = near_links(sketches, lambda nodes: texts(heads.join(nodes, "node")))
    tops = found.select(F.col("component").alias("node"), "component").distinct()
    placed = classes.join(found.unionByName(tops), "node", "left")
    winners = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("_least"), F.min_by("first", F.coalesce("least", F.lit(LARGEST))).alias("_first"))
    groups = placed.join(winners, "component", "left").filter("members > 1 OR _first IS NOT NULL")
    linked = F.col("_first").isNotNull()
    groups = groups.select("d1", "d2", F.when(linked, F.col("_least")).otherwise(F.col("least")).alias("_least"), F.coalesce("_first", "first").alias("_first"))
    groups = materialise(groups, "groups")
    discard(classes, sketches, found)
    rows = rows.drop("sketch")
    some = salted_left_join(rows.filter("n > 0"), groups, ["d1", "d2"], SALTS)
    alone = rows.filter("n = 0").withColumn("_least", F.lit(None).cast("bigint")).withColumn("_first", F.lit(None).cast("bigint"))
    least = F.when(F.col("_first").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return some.unionByName(alone).withColumn("_least", least).withColumn("_first", F.coalesce("_first", "_row"))


SKETCH = "n bigint, d1 bigint, d2 bigint, sketch array<bigint>"


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Texts without words, and null ones, have no shingles and are alone. Rows with equal sets are linked at once. Rows
    that repeat an id are rows of their own, each with its own text's links. A component's id is the smallest id in it;
    null ids do not count, and a component of null ids alone has a null id. Rows with a null id are linked like others;
    one is kept only if no row of its component has an id, and then one of them. An empty table gives no rows; other
    columns are ignored. Shingles are compared by 64-bit hashes of their words; full sets are compared hash by hash.
    """
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    made = docs.mapInArrow(tidy(_sketches(2, ["doc_id", "_key"])), f"doc_id bigint, _key bigint, {SKETCH}")
    rows = materialise(made.withColumn("_row", F.monotonically_increasing_id()), "sketches")
    unique = rows.groupBy("doc_id", "_key").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count() == 0

    def texts(heads: DataFrame) -> DataFrame:
        """Of rows with the same id and text any one will do."""
        keys = rows.join(heads, "_row").select("node", F.col("doc_id").alias("_id"), F.col("_key").alias("_hash"))
        met = docs.join(broadcast_below(keys, NODE_BYTES), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash"))).select("node", "_text")
        return met if unique else met.dropDuplicates(["node"])

    out = _grouped(rows.drop("_key"), texts)
    kept = F.when(F.col("doc_id").isNull(), F.col("_row") == F.col("_first")).otherwise(F.col("doc_id").eqNullSafe(F.col("_least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("_least").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with exactly one row of each group of near copies, one with the smallest id; columns as they are.

    Null ids come last; of rows that repeat the id any one stays. Rows without words stay. Decisions are by row, so
    repeated and null ids lose no other text. An empty table gives no rows; columns of any name pass through.
    """
    plain = renamed(docs)
    at = docs.columns.index(text)
    kinds = T_.StructType([*plain.schema.fields, *T_.StructType.fromDDL(SKETCH).fields])
    made = plain.mapInArrow(tidy(_sketches(at, plain.columns)), kinds)
    rows = materialise(made.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    texts = lambda heads: rows.join(broadcast_below(heads, NODE_BYTES), "_row").select("node", f"c{at}")
    out = _grouped(rows.select("_row", F.col(f"c{docs.columns.index(ident)}").cast("bigint").alias("doc_id"), "n", "d1", "d2", "sketch"), texts)
    gone = materialise(out.filter("_row <> _first").select("_row"), "gone")
    return rows.join(broadcast_below(gone, NODE_BYTES), "_row", "left_anti").select(*plain.columns).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY 1),
numbered AS (SELECT node, len(s) AS n, hash(x) AS h FROM (SELECT node, s, unnest(s) AS x FROM classes)),
often AS (SELECT h, count(*) AS df FROM numbered GROUP BY 1),
ranked AS (SELECT node, n, h, row_number() OVER (PARTITION BY node ORDER BY df, h) AS k FROM numbered JOIN often USING (h)),
heads AS (SELECT node, n, h FROM ranked WHERE k <= n - ceil(0.75 * n) + 1),
pairs AS (SELECT DISTINCT a.node AS x, b.node AS y FROM heads a JOIN heads b ON a.h = b.h AND a.node < b.node AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
links AS (SELECT x, y FROM pairs JOIN classes a ON a.node = x JOIN classes b ON b.node = y
          WHERE 100 * len(list_intersect(a.s, b.s)) >= 75 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(node, top) AS (SELECT node, node FROM classes UNION SELECT b.y, r.top FROM reach r JOIN both_ways b ON b.x = r.node WHERE r.top < b.y),
tops AS (SELECT node, min(top) AS top FROM reach GROUP BY 1),
found AS (SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(t.top, s.doc_id) AS component_id
          FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN tops t ON t.node = c.node)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM found
"""
