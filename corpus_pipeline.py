"""A corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed; what is left is encoded.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
Extra columns stay. Nulls, ties, repeated rows and empty tables are as each stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqtrail.llm import bpe, exact_dedup, minhash, mixing, toxicity
from reqtrail.llm.common import discard, materialise


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5 for toxicity; the model learns from labelled rows of these documents."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out at random so that all sources weigh the same, in one global order."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digest and that of the bytes that they decode to."""
    return bpe.encoded(docs)


STAGES = [("toxicity", clean), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("bpe", tokens)]

#: Toxicity scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        docs = last = made
    return STAGES[-1][1](spark, docs, sf_dir)
