"""Document fingerprints: threshold-scaled sketches of five-word shingles, with DataFrame functions alone.

A sketch retains every shingle hash below one fixed fraction of the hash range, 1/SCALE, whatever the document's size.
So the sketch of a union of documents is the union of their sketches, and the share of a short document that a long
one contains is the share of its retained hashes that the long one retains. Hashes are the first 16 digits of the
MD5 sum of a shingle's words joined by blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_ranges, range_of

WORDS = 5
#: One hash in so many is retained: those whose first digit is below BELOW.
SCALE, BELOW = 4, "4"
DIGITS = 16


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """MD5 sums of the runs of five words ([^\\x20\\x09-\\x0D]+); fewer words are one run; none gives []."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    several = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.md5(F.concat_ws(" ", *[w[i + k] for k in range(words)])))
    return F.transform(F.array(parts), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < words, F.array(F.md5(F.array_join(w, " ")))).otherwise(several(w)))[0]


def sketch(text: Column) -> Column:
    """Sorted array of the distinct retained hashes, in hexadecimal."""
    retained = F.filter(shingle_hashes(text), lambda h: h < F.lit(BELOW))
    return F.sort_array(F.array_distinct(F.transform(retained, lambda h: F.substring(h, 1, DIGITS))))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two documents together: of all shingles that one of them has."""
    return F.sort_array(F.array_union(a, b))


def merged(sketches: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """by and the merged sketch of each group, partially merged before the shuffle: hashes are distinct in it."""
    each = sketches.select(*by, F.explode_outer(column).alias("_hash")).distinct()
    return each.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a retains none. Its error is about sqrt((SCALE - 1) * c * (1 - c) / shingles of a)."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """The larger of both containments, 0 to 1: shared hashes over those of the smaller sketch; 0 where a sketch retains nothing."""
    part = F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double"))
    return F.coalesce(part, F.lit(0.0))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, _text) with a sketch and the text and sketch of the next row in descending doc_id; after the last comes the first.

    Each range of ids is one task, which sorts it by itself and holds a copy of the first row of the range below it.
    """
    cuts = id_ranges(docs)
    keyed = docs.withColumn("_range", range_of(F.col("doc_id"), cuts))
    tops = keyed.groupBy("_range").agg(F.max("doc_id").alias("_top"))  # a row for each range, of which there are MOST_RANGES at most
    by_range = Window.orderBy("_range")
    tops = tops.withColumn("_to", F.coalesce(F.lead("_range").over(by_range), F.first("_range").over(by_range))).select("_top", "_to")
    heads = docs.join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("_top"))).groupBy("_to").agg(F.min(F.struct(F.xxhash64("_text"), F.col("_text")))["_text"].alias("_text"))
    ghosts = heads.select(F.lit(None).cast("bigint").alias("doc_id"), "_text", F.col("_to").alias("_range"), F.lit(True).alias("_ghost"))
    rows = keyed.withColumn("_ghost", F.lit(False)).unionByName(ghosts).repartitionById(len(cuts) + 1, "_range")
    rows = rows.withColumn("_sketch", sketch(F.col("_text")))
    order = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("_text"), "_text")
    return rows.withColumn("_next", F.lead("_text").over(order)).withColumn("_next_sketch", F.lead("_sketch").over(order)).filter(~F.col("_ghost"))


def fingerprints(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, sketch, fingerprint) of every whole text, in the rows' own form: null and repeated ids and rows stay.

    Null text counts as empty and, like any text without words, has no shingles and an empty fingerprint. An empty
    table gives no rows; other columns are ignored.
    """
    of = sketch(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(ident), of.alias("sketch")).withColumn("fingerprint", F.array_join("sketch", ","))


def edited_likeness(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next row's
    text in descending doc_id. Equal texts have likeness 1; else it is 0 where a sketch is empty. Null text counts as
    empty. Null ids come last; rows that repeat an id are ordered by text. A lone row is its own next. An empty table
    gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(docs).withColumn("n_chars", F.length("_text").cast("bigint")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    rows = rows.withColumn("_edited", F.expr("concat(substring(_text, 1, int(n_chars) - _half), substring(_next, 1, _half))"))
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited")))
    a, e, n = F.col("_sketch"), F.col("_edited_sketch"), F.col("_next_sketch")
    same = lambda other: F.when(F.col("_text") == F.col(other), F.lit(1.0))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(a, ",").alias("fingerprint"),
        F.array_join(e, ",").alias("edited_fingerprint"),
        same("_edited").otherwise(likeness(a, e)).alias("near_edited"),
        same("_next").otherwise(likeness(a, n)).alias("near_next"),
    )


def _sketch_sql(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(list_filter(list_transform(
        range(1, greatest(len(w) - 3, 2)), lambda k: md5(array_to_string(w[k : k + 4], ' '))), lambda h: h < '4'), lambda h: substr(h, 1, 16)))) END FROM (SELECT {words} AS w))"""


_NEAR_SQL = "CASE WHEN t = {t} THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) END"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u FROM d),
e AS (SELECT doc_id, t, u, length(t) AS n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2) AS x FROM n),
s AS (SELECT *, {_sketch_sql("t")} AS a, {_sketch_sql("x")} AS b, {_sketch_sql("u")} AS c FROM e)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
       {_NEAR_SQL.format(t="x", a="a", b="b")} AS near_edited, {_NEAR_SQL.format(t="u", a="a", b="c")} AS near_next
FROM s
"""
