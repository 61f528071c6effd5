"""Queries of the training-data operators: each over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprints, fm_index, minhash, mixing, suffix_doubling, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for a costly step on each row: where its scan has fewer tasks than the session has cores, rows are dealt out first."""
    rows, cores = _table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_dealt(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dealt(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_query(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.repeated_words(_dealt(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_doubling.repeated_bytes(_dealt(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_dealt(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_dealt(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_document_fingerprints, op2_token_files, op3_minhash, op4_toxicity, op5_exact_dedup, op6_mixing, op7_substring_dedup, op8_suffix_dedup, op9_bpe, op10_warc)
}
ORACLE_SQL: dict[str, str] = {
    "op1_document_fingerprints": fingerprints.ORACLE_SQL,
    "op3_minhash": minhash.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op7_substring_dedup": fm_index.ORACLE_SQL,
    "op8_suffix_dedup": suffix_doubling.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
