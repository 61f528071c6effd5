"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A document of a source that is to be seen r times on average gets a Poisson(r) number of copies: the inverse
distribution function at a uniform number made from a hash of the seed and the id. Copies are then put into one
global order by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, renamed, salted_left_join

SEED = "mix-1"
#: A uniform number has 52 bits: 13 digits of an MD5 sum.
DIGITS, SCALE = 13, float(1 << 52)
#: Sources up to which their rates are broadcast; more sources are joined by a shuffle with salted keys.
BROADCAST_SOURCES = 10_000
#: Rates up to which the distribution function is summed from 0 in an array; beyond, exp(-rate) vanishes and the sum begins near the mode.
PLAIN_RATE = 700
#: Copies of a document that one array holds, and characters in a stretch of the global order where there are many.
COPIES, PART_CHARS = 1 << 16, 128 << 20


def unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from the MD5 sum of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(_source, _none, _size, _rate) of docs (source, text): mean repetitions so that a source's expected share of characters is its weight.

    Sizes are code points of the whole corpus. Without weights all sources weigh the same. A source that has no
    weight gets rate 0; a null source (_none) is a source of its own, with weight under the key None. Sources without
    characters get rate 0.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("_size"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.lit(1.0))
    else:
        named = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*named) if named else F.create_map().cast("map<string,double>")
        weight = F.when(F.col("_none"), F.lit(float(weights.get(None, 0.0)))).otherwise(F.try_element_at(given, F.col("_source")))
        sizes = sizes.withColumn("_weight", F.coalesce(weight, F.lit(0.0)))
    totals = sizes.agg(F.sum("_size").alias("_all"), F.sum(F.when(F.col("_size") > 0, F.col("_weight")).otherwise(0.0)).alias("_weights"))
    rate = F.coalesce(F.try_divide(F.col("_weight") * F.col("_all") * F.lit(float(epochs)), F.col("_weights") * F.col("_size")), F.lit(0.0))
    return sizes.join(F.broadcast(totals)).select("_source", "_none", "_size", rate.alias("_rate"))  # one row of totals


def distribution(rate: Column) -> Column:
    """Array of the distribution function at 0, 1, ... until what remains is below a double's precision."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), first, grow, lambda acc: acc["all"])


def band(rate: Column) -> tuple[Column, Column]:
    """First and last count of a large rate; what is outside is below a double's precision."""
    reach = 10 * F.sqrt(rate) + 30
    return F.floor(rate - reach), F.ceil(rate + reach)


def least_probability(rate: Column) -> Column:
    """Probability of the first count of the band, so that the band sums to 1."""
    first, last = band(rate)
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("c"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"))

    return F.aggregate(F.sequence(first + 1, last), begin, add, lambda acc: 1 / acc["c"])


def banded_count(rate: Column, least: Column, u: Column) -> Column:
    """The inverse distribution function at u for a large rate, by a walk over the band: about 20 * sqrt(rate) steps for rate copies."""
    first, last = band(rate)
    begin = F.struct(least.alias("p"), least.alias("c"), (first + (least <= u).cast("bigint")).alias("n"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["n"] + (acc["c"] + p <= u).cast("bigint")).alias("n"))

    return F.aggregate(F.sequence(first + 1, last), begin, add, lambda acc: acc["n"])


def replicated(docs: DataFrame, weights: dict[str | None, float] | None, epochs: float, seed: str, ident: str) -> DataFrame:
    """The rows of docs, their columns renamed to c0, c1, ..., by their counts and in global order, with _copy and _order."""
    plain = renamed(docs)
    column = lambda name: F.col(f"c{docs.columns.index(name)}")
    rate, large = F.col("_rate"), F.col("_rate") > PLAIN_RATE
    table = materialise(rates(plain.select(column("source").alias("source"), column("text").alias("text")), weights, epochs), "rates")
    sources, size = table.agg(F.count("*"), F.sum(F.col("_rate") * F.col("_size"))).first()
    table = table.drop("_size").withColumn("_cdf", F.when(~large, distribution(rate))).withColumn("_least", F.when(large, least_probability(rate)))
    keyed = plain.withColumn("_source", F.coalesce(column("source"), F.lit(""))).withColumn("_none", column("source").isNull())
    key = ["_source", "_none"]
    joined = keyed.join(F.broadcast(table), key, "left") if sources <= BROADCAST_SOURCES else salted_left_join(keyed, table, key)
    name = F.coalesce(column(ident).cast("string"), F.lit(""))
    u = unit(F.lit(seed), name)
    count = F.size(F.filter("_cdf", lambda c: c <= u)).cast("bigint")
    counted = joined.withColumn("_n", F.when(large, banded_count(rate, F.col("_least"), u)).otherwise(count))
    runs = counted.filter("_n > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES))))
    copies = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * COPIES, F.least(F.col("_n"), (F.col("_run") + 1) * COPIES) - 1)))
    out = copies.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("_copy"))))
    # MD5 sums are uniform, so their leading digits deal the rows into equal stretches of the order.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / PART_CHARS))
    part = F.floor(F.conv(F.substring("_order", 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE) * F.lit(parts)).cast("int")
    return out.select(*plain.columns, "_copy", "_order").repartitionById(parts, part).sortWithinPartitions("_order")


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = SEED, ident: str = "doc_id") -> DataFrame:
    """docs with each row repeated by its Poisson count, globally shuffled; adds _copy (from 0) and _order.

    The same id, seed and rates give the same count and order. A null id counts as the id ''; rows that repeat an
    id get the same count. Null text has no characters, yet its row is drawn like any other of its source. An empty
    table gives no rows; other columns stay, but those named _copy and _order are replaced. Rates may be of any size.
    """
    out = replicated(docs, weights, epochs, seed, ident)
    kept = [k for k, name in enumerate(docs.columns) if name not in ("_copy", "_order")]
    return out.select(*[f"c{k}" for k in kept], "_copy", "_order").toDF(*[docs.columns[k] for k in kept], "_copy", "_order")


def mixed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = SEED, ident: str = "doc_id") -> DataFrame:
    """mixed_documents() with the columns of docs alone, whatever their names."""
    return replicated(docs, weights, epochs, seed, ident).drop("_copy", "_order").toDF(*docs.columns)


def mixed_query(docs: DataFrame) -> DataFrame:
    """Per drawn copy: the document's columns, copy and shuffle_key, in global order; equal weights for all sources."""
    return mixed_documents(docs).select("doc_id", "text", "lang", "source", "n_chars", F.col("_copy").cast("bigint").alias("copy"), F.col("_order").alias("shuffle_key"))


MIX_SQL = """
sizes AS (SELECT source AS src, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM {docs} GROUP BY 1),
rates AS (SELECT src, coalesce(CASE WHEN size > 0 THEN (1.0 * (SELECT sum(size) FROM sizes) * 1.0)
                 / (CAST((SELECT count(*) FROM sizes WHERE size > 0) AS DOUBLE) * size) END, 0.0) AS rate FROM sizes),
bands AS (SELECT src, rate, rate > 700 AS large, CASE WHEN rate > 700 THEN CAST(floor(rate - (10 * sqrt(rate) + 30)) AS BIGINT) ELSE 0 END AS first,
                 CASE WHEN rate > 700 THEN CAST(ceil(rate + (10 * sqrt(rate) + 30)) AS BIGINT) ELSE CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT) END AS last FROM rates),
relative AS (SELECT src, rate, first AS k, last, CAST(1.0 AS DOUBLE) AS p, CAST(1.0 AS DOUBLE) AS c FROM bands WHERE large
             UNION ALL SELECT src, rate, k + 1, last, p * rate / (k + 1), c + p * rate / (k + 1) FROM relative WHERE k < last),
begins AS (SELECT b.src, b.rate, b.first, b.last, CASE WHEN large THEN 1 / r.c ELSE exp(-b.rate) END AS p
           FROM bands b LEFT JOIN relative r ON r.src IS NOT DISTINCT FROM b.src AND r.k = r.last),
terms AS (SELECT src, rate, first, last, first AS k, p, p AS c FROM begins
          UNION ALL SELECT src, rate, first, last, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < last),
cdfs AS (SELECT src, first, list(c ORDER BY k) AS cdf FROM terms GROUP BY ALL),
counted AS (SELECT d.*, first + len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
            FROM {docs} d JOIN cdfs ON d.source IS NOT DISTINCT FROM src),
copies AS (SELECT * EXCLUDE (n, copy), CAST(copy AS BIGINT) AS copy, md5('mix-1:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy) AS shuffle_key
           FROM (SELECT *, unnest(range(n)) AS copy FROM counted))
"""
ORACLE_SQL = "WITH RECURSIVE " + MIX_SQL.format(docs="documents") + "SELECT doc_id, text, lang, source, n_chars, copy, shuffle_key FROM copies"
