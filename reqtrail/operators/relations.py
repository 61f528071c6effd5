"""Filters, lookups, groups and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kept import numbered
from .sizes import broadcast_if_small

# Documents whose roles are filtered, the words that keep a role, and the outcome that counts.
ROLE_DOCUMENTS = ("9110", "9111", "9112")
ROLE_WORDS = ("server", "sender", "recipient")
FULL_MATCH = "Fully Matches"


def role_filter(df: DataFrame, document: str, role: str = "Role") -> DataFrame:
    """Rows of the role documents whose role names a server, sender or recipient; all rows of other documents."""
    if str(document) not in ROLE_DOCUMENTS:
        return df
    low = F.lower(F.coalesce(F.col(f"`{role}`"), F.lit("")))
    keep = F.lit(False)
    for w in ROLE_WORDS:
        keep = keep | F.contains(low, F.lit(w))
    return df.filter(keep)


def outcome_filter(df: DataFrame, outcome: str = FULL_MATCH, column: str = "outcome") -> DataFrame:
    return df.filter(F.col(column) == outcome)


def drop_all_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without rows whose columns are all null or empty text; '[]' is not empty."""
    from .dictionary import all_empty

    return df.filter(~all_empty(list(columns)))


def drop_unmatched(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(path, F.lit(s))
    return out


def left_enrich(rows: DataFrame, functions: DataFrame, on: str = "function_id", drop: Sequence[str] = ("function_name",)) -> DataFrame:
    """Results with the columns of their functions; rows without one stay, and repeated ids fan out."""
    return rows.drop(*drop).join(functions, on, "left")


def assign_groups(requirements: DataFrame, groups: DataFrame, ident: str = "sr_id") -> DataFrame:
    """Requirements with the group and subgroup that groups has for them; the others keep theirs."""
    side = broadcast_if_small(groups.select(F.col("sr_id").alias("_id"), F.col("group").alias("_group"), F.col("subgroup").alias("_subgroup")))
    out = requirements.join(side, F.col(ident) == F.col("_id"), "left")
    for c in ("group", "subgroup"):
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c) if c in requirements.columns else F.lit(None).cast("string")))
    return out.drop("_id", "_group", "_subgroup")


def flatten_groups(nested: DataFrame, column: str = "groups") -> DataFrame:
    """(sr_id, group, subgroup) of a map<string, map<string, array<string>>> column; ids that are no numbers are left out, of repeated ids the last counts.

    Maps that come from JSON keep its order; those from Python dicts do not, so read_groups() is for files."""
    one = nested.select(F.posexplode(F.map_entries(column)).alias("_i", "_g"))
    two = one.select("_i", F.col("_g.key").alias("group"), F.posexplode(F.map_entries("_g.value")).alias("_j", "_s"))
    three = two.select("_i", "_j", "group", F.col("_s.key").alias("subgroup"), F.posexplode("_s.value").alias("_k", "_id"))
    ids = three.withColumn("sr_id", F.expr("try_cast(_id AS int)")).filter("sr_id IS NOT NULL")
    last = F.struct("_i", "_j", "_k")
    return ids.groupBy("sr_id").agg(F.max_by("group", last).alias("group"), F.max_by("subgroup", last).alias("subgroup"))


def neighbours(df: DataFrame, partition: str, order: str, text: str) -> DataFrame:
    """df with prev_paragraph and next_paragraph in each partition's order."""
    w = Window.partitionBy(partition).orderBy(order)
    return df.withColumn("prev_paragraph", F.lag(text).over(w)).withColumn("next_paragraph", F.lead(text).over(w))


def sequential_ids(df: DataFrame, order: Sequence[str], name: str = "function_id") -> DataFrame:
    """df with ids 1..n in a total order of columns of any types, without bringing all rows into one task."""
    return numbered(df, name, order, first=1)


def stacked(tables: dict[str, DataFrame], name: str = "project") -> DataFrame:
    """Tables of several projects as one, with a column for the project."""
    out = None
    for key, df in tables.items():
        df = df.withColumn(name, F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def negatives(rows: DataFrame, ident: str, value: str, n: int, seed: int) -> DataFrame:
    """rows, whose ids run from 0 to n - 1, each with the value of a row chosen by the MD5 sum of the seed and its id (itself at times)."""
    other = rows.select(F.col(ident).alias("_other"), F.col(value).alias("negative"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    chosen = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(n)
    return rows.withColumn("_other", chosen).join(other.hint("merge"), "_other", "left").drop("_other")  # never by way of the driver


def flattened(rows: DataFrame, text: str = "SR Text", name: str = "sr", without: Sequence[str] = ("Conditions", "Actions")) -> DataFrame:
    """Rows for JSON output: the text column first under its short name, lists as they are, then all other columns but the comma-joined forms."""
    lists = [c for c in ("condition_list", "action_list") if c in rows.columns]
    rest = [c for c in rows.columns if c not in (text, *without, *lists)]
    out = rows.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in (*lists, *rest)])
    return out.toDF(name, *[c.removesuffix("_list") + "s" for c in lists], *rest)


def capped(df: DataFrame, rows: int | None) -> DataFrame:
    """The first rows, for smoke tests of costly stages; None keeps all."""
    return df if rows is None else df.limit(rows)


def sample_values(df: DataFrame, columns: Sequence[str], values: int = 3, seed: int = 1) -> DataFrame:
    """(column, value): a few random values of each column that are not null, for a look at what a join meets."""
    out = None
    for c in columns:
        some = df.select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")).filter("value IS NOT NULL").orderBy(F.rand(seed)).limit(values)
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("no columns")
    return out
