"""Token-overlap similarity join with ranked candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import token_set
from .sizes import BROADCAST_BYTES, broadcast_if_small, row_bytes

TOP_K = 10
#: Counts of functions and requirements, and shared tokens, that a task holds at once.
CELLS = 1 << 17
#: Functions, tokens of one batch included, that a task takes at once.
ROWS = 512


def _postings(requirements: DataFrame, requirement: tuple[str, str]) -> DataFrame:
    """(_token, _list): for each token of the requirements the structs (id, number of distinct tokens) of those that have it."""
    s_id, s_text = requirement
    side = requirements.select(F.col(s_id).alias("_sr"), token_set(F.col(s_text)).alias("_tokens"))
    side = side.select(F.struct("_sr", F.size("_tokens").alias("_n")).alias("_s"), F.explode("_tokens").alias("_token"))
    return side.groupBy("_token").agg(F.collect_list("_s").alias("_list"))


def overlap_scores(functions: DataFrame, requirements: DataFrame, function: tuple[str, str] = ("function_id", "source_code"), requirement: tuple[str, str] = ("sr_id", "sr")) -> DataFrame:
    """(function id, requirement id, score) of all pairs that share a token; score is the share of the requirement's distinct tokens.

    Each side names its id and text. Tokens are distinct before they are joined, the requirements' side is a list of
    ids for each token, and counts are summed in each task before the shuffle.
    """
    f_id, f_text = function
    s_id = requirement[0]
    index = broadcast_if_small(_postings(requirements, requirement))
    tokens = functions.select(F.col(f_id), F.explode(token_set(F.col(f_text))).alias("_token"))
    hits = tokens.join(index, "_token").select(f_id, F.explode("_list").alias("_s"))
    counted = hits.groupBy(f_id, F.col("_s._sr").alias(s_id), F.col("_s._n").alias("_n")).agg(F.count("*").alias("_shared"))
    return counted.select(f_id, s_id, (F.col("_shared").cast("double") / F.col("_n")).alias("score"))


def top_candidates(scores: DataFrame, function: str = "function_id", requirement: str = "sr_id", k: int = TOP_K) -> DataFrame:
    """The k best requirements of each function with their rank; ties go by the requirement's order."""
    order = Window.partitionBy(function).orderBy(F.desc("score"), F.asc(requirement))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_overlaps(functions: DataFrame, requirements: DataFrame, k: int = TOP_K, function: tuple[str, str] = ("function_id", "source_code"), requirement: tuple[str, str] = ("sr_id", "sr"), limit: int = BROADCAST_BYTES) -> DataFrame:
    """(function id, requirement id, score, rank): what top_candidates() of overlap_scores() gives, without a row for each pair.

    Where the requirements' lists take at most `limit` bytes, every task has them, scores its functions against all
    requirements in counts of shared tokens, and only the k best of each come out; nothing is shuffled. Larger tables
    go by overlap_scores(). Rows of functions that repeat an id are scored each by itself here.
    """
    f_id, s_id = function[0], requirement[0]
    index = _postings(requirements, requirement)
    if (index.agg(F.sum(row_bytes(index))).first()[0] or 0) > limit:
        return top_candidates(overlap_scores(functions, requirements, function, requirement), f_id, s_id, k)
    entries = index.select("_token", F.explode("_list").alias("_s")).select("_token", "_s._sr", "_s._n").orderBy(F.col("_sr").asc_nulls_first(), "_n").toArrow().combine_chunks()
    tokens = entries.column("_token").combine_chunks().dictionary_encode()
    tokens = tokens if isinstance(tokens, pa.DictionaryArray) else tokens.combine_chunks()
    ids, sizes = entries.column("_sr").combine_chunks(), np.asarray(entries.column("_n"))
    # Entries of one requirement are neighbours; each requirement has a place in the order of ids.
    same = ids.dictionary_encode().indices if len(ids) else pa.array([], pa.int32())
    key = np.asarray(same.fill_null(-1)).astype(np.int64) * (int(sizes.max(initial=0)) + 1) + sizes
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    names, share = ids.take(pa.array(first)), sizes[first].astype(np.float64)
    code = np.asarray(tokens.indices).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    words, held, at = tokens.dictionary, place[order], np.searchsorted(code[order], np.arange(len(tokens.dictionary) + 1))

    def run(batches):
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            lists = batch.column(1)
            found = np.asarray(pc.index_in(lists.flatten(), value_set=words).fill_null(-1)).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))[found >= 0]
            found = found[found >= 0]
            n = at[found + 1] - at[found]
            # Functions up to each, and their hits: a step has at most so many cells and hits, or one function.
            until = np.append(0, np.cumsum(n))[np.searchsorted(owner, np.arange(len(lists) + 1))]
            most, lo = max(1, CELLS // max(1, len(share))), 0
            while lo < len(lists) and len(share):
                rows = max(1, min(most, len(lists) - lo, int(np.searchsorted(until, until[lo] + CELLS, "right")) - 1 - lo))
                a, b = np.searchsorted(owner, [lo, lo + rows])
                some = n[a:b]
                ends = np.cumsum(some)
                hits = held[np.repeat(at[found[a:b]] - (ends - some), some) + np.arange(int(some.sum()))]
                counts = np.bincount(np.repeat(owner[a:b] - lo, some) * len(share) + hits, minlength=rows * len(share)).reshape(rows, -1)
                row, what = np.nonzero(counts)
                score = counts[row, what] / share[what]
                best = np.lexsort((what, -score, row))
                row, what, score = row[best], what[best], score[best]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                top = rank <= k
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[top] + lo)), names.take(pa.array(what[top])), pa.array(score[top]), pa.array(rank[top].astype(np.int32))], names=[f_id, s_id, "score", "rank"])
                lo += rows

    kinds = T.StructType([functions.schema[f_id], requirements.schema[s_id], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return functions.select(f_id, token_set(F.col(function[1])).alias("_tokens")).mapInArrow(run, kinds)


def candidates(functions: DataFrame, requirements: DataFrame, k: int = TOP_K, function: tuple[str, str] = ("function_id", "source_code"), requirement: tuple[str, str] = ("sr_id", "sr")) -> DataFrame:
    """Every function with the list of its k best requirements; functions that match none are kept with an empty list."""
    f_id, s_id = function[0], requirement[0]
    best = best_overlaps(functions, requirements, k, function, requirement)
    lists = best.groupBy(f_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", s_id))), lambda x: x[s_id]).alias("sr_ids"))
    kind = dict(requirements.dtypes)[s_id]
    return functions.join(lists, f_id, "left").withColumn("sr_ids", F.coalesce("sr_ids", F.array().cast(f"array<{kind}>")))
