"""Connected components by alternating large-star and small-star rounds.

DataFrame operations only.  Each round is two partial-aggregated minima joined
to the edges; a node with very many neighbours is split by the adaptive skew
join, and nothing is gathered per node.  Rounds are cut by checkpoints in the
shared folder and end when the edge set no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(e: DataFrame):
    """A sum over the edge set that changes with it."""
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    # every edge has v < u here
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge; root is the component's smallest node.

    Nodes may be of any ordered type.  Edges with a null end, loops and
    repeated edges add nothing; without edges the result is empty.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("__two"))
    e = cut(e.where("__two").select("u", "v").distinct())
    before = _state(e)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        after = _state(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
