"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are turned into integer weights.  Query rows and candidate rows are hashed into blocks, and every query block
meets every candidate block in one task: for each term (dimension) the candidates' posting list is scattered into a
dense row, and every query row with that term adds its weighted postings to its row of a dense score array.  A
partition selection keeps k candidates per query and block, and a window merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a query block and of a candidate block; a task's score array has QUERY_ROWS x SLAB cells.
QUERY_ROWS, CANDIDATE_ROWS, SLAB = 512, 8192, 2048


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, weights): floor(scale * x) per component; vectors that are null or hold null or non-finite values go."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"))


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of weights; shorter vectors are filled with zeros, which are no postings."""
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row
    return out


def _accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, one term at a time."""
    terms = min(queries.shape[1], candidates.shape[1])
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(terms, 1)
    if reach >= 2**62:
        kind = object  # beyond 64 bits: Python integers, exact at any size
    else:
        kind = np.int32 if reach < 2**31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    step = np.empty_like(scores)
    for t in range(terms):
        posting = np.flatnonzero(candidates[:, t])
        users = np.flatnonzero(queries[:, t])
        if not len(posting) or not len(users):
            continue
        weights = queries[users, t].astype(kind)
        if 4 * len(posting) < len(candidates):  # short list: scatter into the few places
            scores[np.ix_(users, posting)] += np.multiply.outer(weights, candidates[posting, t].astype(kind))
        else:
            dense = np.zeros(len(candidates), kind)
            dense[posting] = candidates[posting, t]
            if len(users) == len(queries):
                np.multiply.outer(weights, dense, out=step)
                scores += step
            else:
                part = np.multiply.outer(weights, dense)
                scores[users] += part
    return scores


def _select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids: the k-th score by partition, all above it, then the smallest ids at it."""
    if len(scores) <= k:
        return np.arange(len(scores))
    bar = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, at = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
    need = k - len(above)
    if len(at) > need:
        at = at[np.argsort(ids[at], kind="stable")[:need]]
    return np.concatenate([above, at])


def _meet(k: int):
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries, asked, key = _matrix(left["weights"]), left["id"].to_numpy(), left["query"].to_numpy()
        own, best = set(), [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(left)
        for lo in range(0, len(right) if len(left) else 0, SLAB):
            part = right.iloc[lo : lo + SLAB]
            ids, rows = part["id"].to_numpy(), part["row"].to_numpy()
            scores = _accumulate(queries, _matrix(part["weights"]))
            for i, q in enumerate(key):
                mine, row = ids, scores[i]
                same = np.flatnonzero((rows == q) & (ids == asked[i])) if i not in own else ()
                if len(same):  # the query's own row, once
                    own.add(i)
                    mine, row = np.delete(mine, same[0]), np.delete(row, same[0])
                # The best so far stand with the slab's, so that a block hands on k rows a query.
                mine, row = np.concatenate([best[i][0], mine]), np.concatenate([best[i][1].astype(row.dtype), row])
                chosen = _select(mine, row, k)
                best[i] = mine[chosen], row[chosen]
        n = [len(ids) for ids, _ in best]
        whole = lambda j: np.concatenate([np.empty(0, np.int64), *[x[j] for x in best]]).astype(np.int64)
        return pd.DataFrame({"query_id": np.repeat(asked, n), "query": np.repeat(key, n), "vec_id": whole(0), "score": whole(1)})

    return task


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query row among all other rows.

    Ties go to the smaller id; fewer than k candidates give fewer rows.  Rows with a null id, or a vector that is null or
    holds null or non-finite components, take no part; an empty vector scores 0.  A row's own is left out once, other
    rows of its id are candidates.  Query rows of one id and different vectors have a ranking each; of equal query rows
    one is asked.  Scores are exact while they fit 64 bits.
    """
    vectors = integer_vectors(df, key, vector, scale)
    asked = integer_vectors(df.where(F.coalesce(is_query, F.lit(False))), key, vector, scale).distinct()
    counts = vectors.agg(F.count("*").alias("n")).first().n, asked.agg(F.count("*").alias("n")).first().n
    n_candidate, n_query = (max(1, -(-n // rows)) for n, rows in zip(counts, (CANDIDATE_ROWS, QUERY_ROWS), strict=True))
    block = lambda n: F.pmod(F.xxhash64("id", "weights"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("query", F.xxhash64("id", "weights"))
    left = asked.withColumn("qb", block(n_query)).withColumn("cb", every(n_candidate))
    right = vectors.withColumn("row", F.xxhash64("id", "weights")).withColumn("cb", block(n_candidate)).withColumn("qb", every(n_query))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_meet(k), "query_id long, query long, vec_id long, score long")
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
