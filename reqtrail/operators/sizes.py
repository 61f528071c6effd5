"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side is broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row and of a list's element besides text.
ROW_BYTES = 64


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, lists by their elements, with those of texts by their sum."""
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        column, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            part = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            part = F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + ROW_BYTES)
        elif isinstance(kind, T.ArrayType | T.MapType):
            part = F.size(column) * ROW_BYTES
        else:
            continue
        size = size + F.coalesce(part, F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if all its rows take at most so many bytes, else as it is: the join then shuffles, and AQE splits hot keys."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit) else df
