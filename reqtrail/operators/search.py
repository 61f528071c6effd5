"""Vector search: scores, top k in chunks, and fuzzy de-duplication."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import similarity

# Rows of a chunk, and when two results count as the same.
CHUNK, SAME_CHARACTERS, SAME_SCORE = 2_000_000, 80, 0.01
#: Queries, about, that are broadcast against all vectors at once, and bytes of their vectors.
QUERIES, QUERY_BYTES = 8_000, 16 << 20
#: Cosines that a task holds at once, and by how much a product of matrices may miss one that is summed in order.
CELLS, MARGIN = 1 << 21, 1e-9


def search(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "cos", chunk: int = CHUNK, ident: str = "id", vector: str = "vec", block: int = QUERIES) -> DataFrame:
    """(query, id, score, rank): each query's k best of each chunk of ids, ranked over all chunks; not yet de-duplicated.

    queries are (query, qvec), with distinct names: a stated set against all rows, in blocks of `block` queries by
    hash, each of which is broadcast. Each task keeps the best of its own rows before anything is shuffled.
    """
    rows, numbers = queries.agg(F.count("*"), F.sum(F.size("qvec"))).first()
    parts = max(1, math.ceil(rows / block), math.ceil(8 * (numbers or 0) / QUERY_BYTES))
    out = None
    for p in range(parts):
        some = queries.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == p) if parts > 1 else queries
        found = _search(vectors, some, k, measure, chunk, ident, vector)
        out = found if out is None else out.unionByName(found)
    return out


def _search(vectors: DataFrame, queries: DataFrame, k: int, measure: str, chunk: int, ident: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(ident).alias("id"), F.floor(F.col(ident) / chunk).alias("_chunk"), F.col(vector).alias("_v"))
    asked = queries.select("query", F.col("qvec").alias("_q"))
    if measure == "cos" and isinstance(rows.schema["id"].dataType, T.IntegralType):
        length = asked.agg(F.mode(F.size("_q"))).first()[0] or 0
        plain, plain_asked = _plain(F.col("_v"), length) & F.col("id").isNotNull(), _plain(F.col("_q"), length)
        scored = _cosines(rows.filter(plain), asked.filter(plain_asked), k)
        scored = scored.unionByName(_scores(rows.filter(~plain), asked, measure)).unionByName(_scores(rows.filter(plain), asked.filter(~plain_asked), measure))
    else:
        scored = _scores(rows, asked, measure)
    best = F.row_number().over(Window.partitionBy("query", "_chunk").orderBy(F.desc("score"), "id"))
    kept = scored.withColumn("_n", best).filter(F.col("_n") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).select("query", "id", "score", "rank")


def _scores(rows: DataFrame, asked: DataFrame, measure: str) -> DataFrame:
    """(query, id, _chunk, score) of all pairs."""
    return rows.join(F.broadcast(asked)).select("query", "id", "_chunk", similarity(F.col("_v"), F.col("_q"), measure).alias("score"))


def _plain(v: Column, length: int) -> Column:
    """Whether a vector has this length, numbers alone, and a norm that neither vanishes nor overflows."""
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists(v, lambda x: F.abs(x) > 1e-100)
    return F.coalesce((F.size(v) == length) & fits, F.lit(False))


def _folded(a: np.ndarray, b: np.ndarray, i, j) -> np.ndarray:
    """Products of columns i of a and j of b, summed in the order of dimensions as vectors.dot() does: equal vectors, equal sums."""
    out = np.zeros(len(a[0, i]) if len(a) else 0)
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def _cosines(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, _chunk, score) with each query's k best of every chunk among them: rows and queries are plain ones of one length.

    Each task multiplies a batch of vectors with all queries at once. What that leaves among a query's best, give or take
    MARGIN, is scored again by the sums of functions.vectors, and the k best go out. Of more than k equal vectors of a
    batch and chunk only the k with the least ids can be among the best.
    """
    table = asked.toArrow().combine_chunks()
    names = pa.concat_arrays(table.column("query").chunks) if table.num_rows else None
    q = np.array(table.column("_q").to_pylist(), np.float64).T.copy() if table.num_rows else np.zeros((0, 0))
    every = slice(None)
    q_norm = np.sqrt(_folded(q, q, every, every))
    q_unit = (q / q_norm).T.copy() if table.num_rows else q
    kinds = T.StructType([asked.schema["query"], rows.schema["id"], rows.schema["_chunk"], T.StructField("score", T.DoubleType())])

    def run(batches):
        least = {}  # of each chunk, how good a query's k-th best is so far
        for batch in batches:
            if names is None or not batch.num_rows:
                continue
            all_ids, chunks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            values = np.asarray(batch.column(2).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            for chunk in np.unique(chunks):
                mine = np.flatnonzero(chunks == chunk)
                mine = mine[np.argsort(all_ids[mine], kind="stable")]
                same = np.unique(values[mine].view(np.dtype((np.void, 8 * values.shape[1]))).ravel(), return_inverse=True)[1].ravel()
                order = np.argsort(same, kind="stable")
                nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
                mine = mine[np.sort(order[nth < k])]
                ids, v = all_ids[mine], values[mine].T.copy()
                norm = np.sqrt(_folded(v, v, every, every))
                unit, bar = v / norm, least.setdefault(chunk, np.full(len(q_unit), -np.inf))
                step = max(1, CELLS // len(ids))
                for lo in range(0, len(q_unit), step):
                    near = q_unit[lo : lo + step] @ unit
                    if len(ids) >= k:
                        bar[lo : lo + step] = np.maximum(bar[lo : lo + step], np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
                    what, row = np.nonzero(near >= bar[lo : lo + step, None] - MARGIN)
                    score = _folded(v, q[:, lo : lo + step], row, what) / (norm[row] * q_norm[lo + what])
                    best = np.lexsort((ids[row], -score, what))
                    best = best[np.arange(len(best)) - np.searchsorted(what[best], what[best]) < k]
                    what, row = what[best] + lo, row[best]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(what)), batch.column(0).take(pa.array(mine[row])), batch.column(1).take(pa.array(mine[row])), pa.array(score[best])], names=kinds.names)

    cores, tasks = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(max(cores, tasks)).mapInArrow(run, kinds)


def fuzzy_distinct(ranked: DataFrame, text: str, score: str = "score", rank: str = "rank", group: str | None = None) -> DataFrame:
    """Rows without those that an earlier one, kept or not, is like: the same first characters and nearly the same score."""
    keys = [group] if group else []
    side = ranked.select(*[F.col(g).alias(f"_{g}") for g in keys], F.substring(text, 1, SAME_CHARACTERS).alias("_head"), F.col(score).alias("_score"), F.col(rank).alias("_rank"))
    like = (F.substring(text, 1, SAME_CHARACTERS) == F.col("_head")) & (F.abs(F.col(score) - F.col("_score")) < SAME_SCORE) & (F.col("_rank") < F.col(rank))
    for g in keys:
        like = like & (F.col(g) == F.col(f"_{g}"))
    return ranked.join(side, like, "left_anti")


def distinct_results(found: DataFrame, texts: DataFrame, k: int, ident: str = "id", text: str = "text") -> DataFrame:
    """What search() found with its texts, each query's first k without what fuzzy_distinct() drops; fewer than k where results are alike.

    Ranks go by score, so of the earlier results with the same first characters the last one is the nearest: a query's
    results are read in one pass, and the search is not run again for a join with itself.
    """
    met = found.join(texts.select(F.col(ident).alias("id"), F.col(text).alias("text")), "id")
    head = F.substring("text", 1, SAME_CHARACTERS)
    earlier = Window.partitionBy("query", head).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    like = head.isNotNull() & F.col("query").isNotNull() & (F.abs(F.col("score") - F.last("score").over(earlier)) < SAME_SCORE)
    distinct = met.withColumn("_like", F.coalesce(like, F.lit(False))).filter(~F.col("_like")).drop("_like")
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("rank") <= k)


def best_results(vectors: DataFrame, texts: DataFrame, queries: DataFrame, k: int, measure: str = "cos", ident: str = "id", vector: str = "vec", text: str = "text") -> DataFrame:
    """Each query's k best results with their text, de-duplicated; fewer than k where results are alike."""
    return distinct_results(search(vectors, queries, k, measure, ident=ident, vector=vector), texts, k, ident, text)
