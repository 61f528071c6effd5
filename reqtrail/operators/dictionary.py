"""The substring join of function keywords with requirement cells, by way of distinct keywords."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_cell, typed_cell
from .sizes import broadcast_if_small

#: Blocks that each side is cut into where the cells are too many to be broadcast.
BLOCKS = 16


def long_keywords(functions: DataFrame, ident: str, columns: Mapping[str, str], mode: str = "compat") -> DataFrame:
    """(ident, column, keyword): a row for each occurrence of a keyword; column is the requirement column it is sought in.

    mode 'compat' splits cells at commas, 'typed' reads them as JSON lists. A cell column that is an array is used as it is.
    """
    kinds = dict(functions.dtypes)
    read = {"compat": split_cell, "typed": typed_cell}[mode]
    cells = [F.struct(F.lit(to).alias("column"), (F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "") if kinds[c].startswith("array") else read(F.col(c))).alias("keywords")) for c, to in columns.items() if c in kinds]
    each = functions.select(ident, F.explode(F.array(*cells)).alias("_cell"))
    return each.select(ident, F.col("_cell.column").alias("column"), F.explode("_cell.keywords").alias("keyword"))


def keyword_matches(keywords: DataFrame, requirements: DataFrame, ident: str, columns: Mapping[str, str], exact: bool = False) -> DataFrame:
    """(column, keyword, ident): requirements whose cell contains each distinct keyword; exact: whose cell, split at commas, has it as an element.

    Equal columns are the join's key, so a keyword only meets cells of its own column.
    """
    kinds = dict(requirements.dtypes)
    cells = [F.struct(F.lit(to).alias("column"), F.col(f"`{to}`").cast("string").alias("value")) for to in dict.fromkeys(columns.values()) if to in kinds]
    side = requirements.select(ident, F.explode(F.array(*cells)).alias("_cell")).select(ident, F.col("_cell.column").alias("column"), F.col("_cell.value").alias("value")).filter("value IS NOT NULL")
    distinct = keywords.select("column", "keyword").distinct()
    if exact:
        each = side.select(ident, "column", F.explode(split_cell(F.col("value"))).alias("keyword"))
        return distinct.join(each, ["column", "keyword"]).select("column", "keyword", ident).distinct()
    # Equal cells are matched once, and their requirements come back by a second join.
    values = side.select("column", "value").distinct()
    few = broadcast_if_small(values)
    if few is not values:
        met = distinct.join(few, "column")
    else:
        # Blocks of keywords meet blocks of values: no task holds all of a column.
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOCKS)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
        met = distinct.withColumn("_i", block("keyword")).withColumn("_j", every).join(values.withColumn("_j", block("value")).withColumn("_i", every), ["column", "_i", "_j"])
    met = met.filter(F.contains("value", "keyword")).select("column", "keyword", "value")
    return met.join(side, ["column", "value"]).select("column", "keyword", ident)


def all_empty(columns: list[str]) -> Column:
    """True if every column is null or empty text."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""))
    return out


def dictionary_join(functions: DataFrame, requirements: DataFrame, columns: Mapping[str, str], function: str = "function_id", requirement: str = "sr_id", mode: str = "compat") -> DataFrame:
    """Functions that match a requirement, with matching_sr_ids: distinct ids, ascending."""
    present = [c for c in columns if c in functions.columns]
    kept = functions.filter(~all_empty(present)) if present else functions
    keywords = long_keywords(kept, function, columns, mode)
    matches = keyword_matches(keywords, requirements, requirement, columns, exact=mode == "typed")
    pairs = keywords.distinct().join(matches, ["column", "keyword"])
    lists = pairs.groupBy(function).agg(F.array_sort(F.collect_set(requirement)).alias("matching_sr_ids"))
    return kept.join(lists, function)


def dictionary_statistics(functions: DataFrame, requirements: DataFrame, columns: Mapping[str, str], function: str = "function_id", requirement: str = "sr_id", mode: str = "compat") -> DataFrame:
    """One row: total_rows, rows_with_match, rows_retained, keywords_checked, keywords_matched, matched_ids, distinct_matched_ids.

    Keywords and matched ids are counted for each occurrence; a keyword whose requirement column is missing is checked but cannot match.
    """
    present = [c for c in columns if c in functions.columns]
    kept = functions.filter(~all_empty(present)) if present else functions
    keywords = long_keywords(kept, function, columns, mode)
    matches = keyword_matches(keywords, requirements, requirement, columns, exact=mode == "typed")
    per_keyword = matches.groupBy("column", "keyword").agg(F.count("*").alias("_hits"))
    totals = keywords.join(per_keyword, ["column", "keyword"], "left").agg(
        F.count_distinct(F.when(F.col("_hits") > 0, F.col(function))).alias("rows_with_match"),
        F.count("*").alias("keywords_checked"),
        F.count_if(F.col("_hits") > 0).alias("keywords_matched"),
        F.coalesce(F.sum("_hits"), F.lit(0)).alias("matched_ids"),
    )
    ids = matches.agg(F.count_distinct(requirement).alias("distinct_matched_ids"))
    rows = functions.agg(F.count("*").alias("total_rows"))
    out = rows.join(F.broadcast(totals)).join(F.broadcast(ids))  # one row each
    return out.select("total_rows", "rows_with_match", F.col("rows_with_match").alias("rows_retained"), "keywords_checked", "keywords_matched", "matched_ids", "distinct_matched_ids")
