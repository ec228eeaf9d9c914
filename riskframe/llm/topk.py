"""Exact inner-product top-k by the threshold algorithm.

Queries and candidates meet in blocks: a grid of candidate blocks by query
blocks, each of bounded size.  Within a pair of blocks every dimension has the
candidates in sorted order.  The block's queries go down all lists together,
each from the end where its component counts most; what any of them meets is
scored in full, and a query stops once the sum of its lists' current values,
which no unseen candidate passes, is below its k-th score.  The blocks' best are
merged by a window of ``k`` rows a block.

Components become floor(scale * x) of the double value; scores are whole
numbers.  Defined results: a row whose vector or id is null, or whose vector
holds a null or non-finite component, takes no part; vectors only meet vectors
of their own length; repeated rows (equal id and vector) are one row; ties go
to the smaller id; scores that would not fit a long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_DEPTH, DEEPER = 16, 4                 # rows of the lists read first, and how much deeper each time
NONE = np.iinfo(np.int64).min


def _best(score: np.ndarray, where: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``k`` best columns: highest scores, then smallest positions (below ``n``; NONE marks no score)."""
    if score.shape[1] > k:
        known = score != NONE
        if float(np.abs(np.where(known, score, 0)).max(initial=0)) * (n + 1) < 2.0 ** 62:
            key = np.where(known, score * n + (n - 1 - where), NONE)          # one whole number orders both
            at = np.argpartition(key, key.shape[1] - k, axis=1)[:, -k:]
        else:
            at = np.lexsort((where, ~score), axis=1)[:, :k]
        score, where = np.take_along_axis(score, at, axis=1), np.take_along_axis(where, at, axis=1)
    return score, where


def _search(v: np.ndarray, own: np.ndarray, q: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and positions of the ``k`` best rows of ``v`` for every query, all queries
    together, and how many rows were met.

    Each round reads the lists of all dimensions to one more depth, from the end that
    a query's sign asks for, and scores what any unfinished query met in one product.
    A query is finished when the sum of its lists' current values is below its k-th score.
    """
    n = len(v)
    order = np.argsort(v, axis=0, kind="stable")
    values = np.take_along_axis(v, order, axis=0)
    score, where = np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)
    seen, depth, open_ = np.zeros(n, bool), FIRST_DEPTH, np.arange(len(q))
    while len(open_):
        depth = min(depth, n)
        some = q[open_]
        up, down = (some > 0).any(axis=0), (some < 0).any(axis=0)
        met = np.full(n, depth == n)
        met[order[n - depth:, up]] = True
        met[order[:depth, down]] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        if len(new):
            found = (some @ v[new].T).astype(np.int64)
            found[query[open_, None] == own[new]] = NONE
            both = np.concatenate([score[open_], found], axis=1), np.concatenate([where[open_], np.broadcast_to(new, found.shape)], axis=1)
            score[open_], where[open_] = _best(*both, k, n)
        if depth == n:
            break
        edge = np.where(some > 0, values[n - depth] * some, values[depth - 1] * some).sum(axis=1)
        open_ = open_[edge >= score[open_].min(axis=1)]
        depth *= DEEPER
    return score, where, int(seen.sum())


def _pair(k: int, scale: float):
    def run(group: pa.Table) -> pa.Table:
        query = group.column("is_query").to_numpy(zero_copy_only=False)
        ids = group.column("vec_id").to_numpy()
        own = group.column("own").to_numpy()
        flat = group.column("vector").combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        x = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(ids), -1)
        most = float(np.abs(x).max(initial=0.0))
        if most * most * max(1, x.shape[1]) >= 2.0 ** 63:
            raise ValueError("scores would not fit a long")
        if most * most * max(1, x.shape[1]) >= 2.0 ** 53:       # no longer exact in doubles
            x = x.astype(np.int64)
        v, vid, vown = x[~query], ids[~query], own[~query]
        by = np.lexsort((vown, vid))                     # positions in the order of ties
        v, vid, vown = v[by], vid[by], vown[by]
        score, where, _ = _search(v, vown, x[query], own[query], k) if len(v) else (np.full((0, k), NONE), np.zeros((0, k), np.int64), 0)
        row, col = np.nonzero(score != NONE)
        at = where[row, col]
        cols = [ids[query][row], own[query][row], vid[at], vown[at], score[row, col]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "query_own", "vec_id", "own", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, block: int = 8192, queries: int = 1024,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best other rows.

    ``is_query`` is a condition on ``vec_id``.  ``block`` and ``queries`` bound the rows of a pair of blocks.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where("vec_id is not null and vector is not null").where(~odd)
    v = v.withColumns({"own": F.xxhash64("vec_id", "vector"), "dim": F.size("vector"), "is_query": is_query}).dropDuplicates(["vec_id", "own"])
    total, asked = v.agg(F.count("*"), F.count_if("is_query")).first()
    nc, nq = max(1, -(-total // block)), max(1, -(-asked // queries))
    spread = F.pmod(F.xxhash64(F.lit(3), "own"), F.lit(nc)).cast("int")
    candidates = v.withColumns({"cb": spread, "is_query": F.lit(False)}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asking = v.where("is_query").withColumn("qb", F.pmod(F.xxhash64(F.lit(5), "own"), F.lit(nq)).cast("int"))
    asking = asking.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    cols = ["cb", "qb", "dim", "is_query", "vec_id", "own", "vector"]
    best = candidates.select(cols).unionByName(asking.select(cols)).groupBy("cb", "qb", "dim").applyInArrow(
        _pair(k, scale), "query_id long, query_own long, vec_id long, own long, score long")
    w = Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), "vec_id", "own")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
