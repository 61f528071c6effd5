"""Streams: every stage without state runs on them as it is, and both joins take a static side."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import dictionary
from ..operators.sizes import BROADCAST_BYTES, broadcast_if_small, row_bytes


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keyword_stream(stream: DataFrame, keywords: Mapping, column: str) -> DataFrame:
    for name, rule in text.keyword_columns(F.col(f"`{column}`"), keywords).items():
        stream = stream.withColumn(name, rule)
    return stream


def overlap_stream(stream: DataFrame, requirements: DataFrame, ident: str, column: str, requirement: tuple[str, str] = ("sr_id", "sr"), limit: int = BROADCAST_BYTES) -> DataFrame:
    """(ident, requirement id, score) of each streamed function with each requirement that shares a token.

    Requirements are a static table, whose tokens with their lists of ids go to every task as one row of at most
    `limit` bytes; a larger table is an error, and overlap.overlap_scores() in run_available() is for those. Tokens are
    looked up and counted inside the row, so the stream keeps no state.
    """
    tokens = requirements.select(F.col(requirement[0]).alias("_id"), text.token_set(F.col(requirement[1])).alias("_want"))
    lists = tokens.select(F.struct("_id", F.size("_want").alias("_n")).alias("_s"), F.explode("_want").alias("_token")).groupBy("_token").agg(F.collect_list("_s").alias("_list"))
    if (lists.agg(F.sum(row_bytes(lists))).first()[0] or 0) > limit:
        raise ValueError("the requirements' tokens are too many for every task")
    index = lists.agg(F.map_from_entries(F.collect_list(F.struct("_token", "_list"))).alias("_index"))  # one row
    none = F.array().cast(lists.schema["_list"].dataType)
    hits = F.flatten(F.transform(text.token_set(F.col(column)), lambda t: F.coalesce(F.try_element_at("_index", t), none)))
    met = stream.join(F.broadcast(index)).select(ident, hits.alias("_hits")).select(ident, "_hits", F.explode(F.array_distinct("_hits")).alias("_s"))
    shared = F.size(F.filter("_hits", lambda x: x["_id"] == F.col("_s._id"))).cast("double")
    return met.select(ident, F.col("_s._id").alias(requirement[0]), (shared / F.col("_s._n")).alias("score"))


def dictionary_stream(stream: DataFrame, requirements: DataFrame, columns: Mapping[str, str], function: str = "function_id", requirement: str = "sr_id") -> DataFrame:
    """(function, requirement) pairs of streamed functions with a static table: one row for each keyword that matches."""
    keywords = dictionary.long_keywords(stream, function, columns)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in dict.fromkeys(columns.values()) if c in requirements.columns]
    side = requirements.select(requirement, F.explode(F.array(*cells)).alias("_c")).select(requirement, F.col("_c.column").alias("column"), F.col("_c.value").alias("value"))
    return keywords.join(broadcast_if_small(side), "column").filter(F.contains("value", "keyword")).select(function, requirement, "column", "keyword")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now in micro-batches, then stop; a restart from the checkpoint repeats no finished batch."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
