"""Exact k-nearest neighbours and SMOTE oversampling without enumerating all pairs.

kNN asks the block index of ``pivots``, for few columns as for many: equal points
are one location that carries its k + 1 smallest ids, so copies are never paired;
a location finds its nearest in its own block and travels only to the other blocks
that its bound reaches.  The number of passes depends neither on the scales nor on
the density of the data.

SMOTE then draws, for every synthetic row, a base minority row, one of its k
neighbours and a step u in [0, 1), all from keyed hashes.  Each minority row
gets q or q+1 synthetic rows, and the total is exactly n_major - n_minor.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..session import cut_lineage
from . import pivots
from .running import running_totals

MAX_CELL = 20000
# Multipliers tried (in this order) for the allocation permutation.
PERMUTATION_MULTIPLIERS = [7919, 7907, 7901, 7883, 7877, 7873]


def knn(points: DataFrame, feats: list[str], k: int = 5, id_col: str = "id",
        max_cell: int = MAX_CELL) -> DataFrame:
    """(id, rank, neighbor_id, distance): the k nearest other points, ties by neighbour id.

    ``max_cell`` bounds the locations of a leaf of the index, about."""
    return pivots.knn(points, feats, k, id_col, block=min(pivots.BLOCK, max_cell))


def _multiplier(n: int) -> int:
    for a in PERMUTATION_MULTIPLIERS:
        if math.gcd(a, n) == 1:
            return a
    return 1


def smote(minority: DataFrame, feats: list[str], n_majority: int, k: int = 5, id_col: str = "id",
          salt: int = 50, neighbors: DataFrame | None = None) -> DataFrame:
    """Synthetic minority rows x + u * (neighbour - x) until both classes have equal counts.

    Returns (base_id, sample, neighbor_id, step, feats...).  Row i gets q or
    q + 1 samples (q = need // n_min); the q + 1 rows are those whose id rank,
    permuted by a multiplier coprime to n_min, falls below need % n_min.
    """
    spark = minority.sparkSession
    base = cut_lineage(minority.select(F.col(id_col).alias("base_id"), *[F.col(f).cast("double") for f in feats]))
    n_min = base.count()
    need = n_majority - n_min
    if need <= 0 or n_min < 2:
        return spark.createDataFrame([], "base_id long, sample int, neighbor_id long, step double, "
                                     + ", ".join(f"`{f}` double" for f in feats))
    nb = neighbors if neighbors is not None else cut_lineage(knn(minority, feats, k, id_col))
    q, rem, a = need // n_min, need % n_min, _multiplier(n_min)
    ranked = running_totals(base.select("base_id", F.lit(1).alias("one")), [], "base_id", ["one"])
    alloc = ranked.select("base_id", (((F.col("cum_one") - 1) * F.lit(a)) % F.lit(n_min)).alias("_perm"))
    alloc = alloc.select("base_id", (F.lit(q) + (F.col("_perm") < F.lit(rem)).cast("int")).alias("m"))
    per = nb.groupBy(F.col(id_col).alias("base_id")).agg(F.max("rank").alias("kk"))
    m_all = alloc.join(per, "base_id").where(F.col("m") > 0)
    samples = m_all.select("base_id", "kk", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("sample"))
    key = ["base_id", "sample"]
    samples = samples.select("base_id", "sample",
                             (F.floor(unit_hash(key, salt + 1) * F.col("kk")) + 1).cast("int").alias("rank"),
                             unit_hash(key, salt + 2).alias("step"))
    pick = samples.join(nb.select(F.col(id_col).alias("base_id"), "rank", "neighbor_id"), ["base_id", "rank"])
    x = base
    y = base.select(F.col("base_id").alias("neighbor_id"), *[F.col(f).alias(f"n_{f}") for f in feats])
    j = pick.join(x, "base_id").join(y, "neighbor_id")
    return j.select("base_id", "sample", "neighbor_id", "step",
                    *[(F.col(f) + F.col("step") * (F.col(f"n_{f}") - F.col(f))).alias(f) for f in feats])
