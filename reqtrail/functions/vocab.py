"""Words to ids and back, and padding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of the special words.
PAD, SOS, EOS, UNK = 0, 1, 2, 3
#: Words up to which a vocabulary becomes a map literal; larger ones are joined.
LITERAL_WORDS = 20_000


def pad(ids: Column, length: int) -> Column:
    """Cut or padded with 0 on the right to a set length; null counts as empty."""
    ids = F.coalesce(ids, F.array().cast("array<int>"))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length)


def words(text: Column, style: str = "blank") -> Column:
    """Words of a sentence: 'blank' splits lower-case text at each single blank, 'token' takes runs of word characters and single signs."""
    if style == "blank":
        return F.split(F.lower(text), " ")
    if style == "token":
        return F.regexp_extract_all(text, F.lit("(?U)\\w+|[^\\w\\s]"), F.lit(0))
    raise ValueError(f"unknown style {style!r}")


def _literal(vocabulary: Mapping[str, int]) -> Column:
    if len(vocabulary) > LITERAL_WORDS:
        raise ValueError(f"{len(vocabulary)} words; use encode_table()")
    return F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv]) if vocabulary else F.create_map().cast("map<string,int>")


def encode(tokens: Column, vocabulary: Mapping[str, int], unknown: int = UNK) -> Column:
    table = _literal(vocabulary)
    return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(unknown)))


def decode(ids: Column, vocabulary: Mapping[str, int], unknown: str = "<unk>") -> Column:
    """Words of ids joined by blanks: padding is dropped, and the end is the first end mark, included."""
    table = _literal({str(v): k for k, v in vocabulary.items()}) if vocabulary else None
    kept = F.filter(ids, lambda i: i != PAD)
    end = F.array_position(kept, F.lit(EOS))
    kept = F.when(end > 0, F.slice(kept, F.lit(1), end.cast("int"))).otherwise(kept)
    if table is None:
        return F.array_join(F.transform(kept, lambda i: F.lit(unknown)), " ")
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.try_element_at(table, i.cast("string")), F.lit(unknown))), " ")


def decoded_length(ids: Column) -> Column:
    kept = F.filter(ids, lambda i: i != PAD)
    end = F.array_position(kept, F.lit(EOS))
    return F.when(end > 0, end.cast("int")).otherwise(F.size(kept))


def encode_table(rows: DataFrame, ident: str, tokens: str, vocabulary: DataFrame, unknown: int = UNK) -> DataFrame:
    """(ident, ids) by a join with a (word, id) table of any size; order is kept."""
    each = rows.select(ident, F.posexplode_outer(tokens).alias("_at", "_word"))
    met = each.join(vocabulary.select(F.col("word").alias("_word"), F.col("id").alias("_id")), "_word", "left")
    pairs = met.groupBy(ident).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_id", F.lit(unknown)).alias("_id"))))).alias("_pairs"))
    return pairs.select(ident, F.transform("_pairs", lambda p: p["_id"]).alias("ids"))
