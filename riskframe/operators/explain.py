"""Coefficient explanations: importance table and ranked top lists.

A coefficient table has one row per model feature, so it is bounded by the
feature count, not by the data: ranking it with a plain window is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def pair_names(names: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(feature_index, feature, coefficient): names and coefficients joined one to one by
    feature_index; raises where either side has an index that the other lacks."""
    j = names.select("feature_index", "feature").join(coefficients.select("feature_index", "coefficient"), "feature_index", "full_outer")
    lone = j.where(F.col("feature").isNull() | F.col("coefficient").isNull()).count()
    if lone:
        raise ValueError(f"{lone} feature names or coefficients have no partner")
    return j


def feature_importance(coefficients: DataFrame) -> DataFrame:
    """abs, effect (>= 0 increases risk), odds ratio exp(clip(coef, +-50)), rank by |coef| desc.

    Input: (feature_index, feature, coefficient).  Ties in |coef| keep the
    feature order (feature_index), which makes the ranking deterministic.
    """
    c = F.col("coefficient")
    t = coefficients.select(
        "feature_index", "feature", c.alias("coefficient"), F.abs(c).alias("abs_coefficient"),
        F.when(c >= 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk")).alias("effect"),
        F.exp(F.least(F.greatest(c, F.lit(-config.ODDS_CLIP)), F.lit(config.ODDS_CLIP))).alias("odds_ratio"))
    w = Window.orderBy(F.col("abs_coefficient").desc(), F.col("feature_index"))
    return t.withColumn("rank", F.row_number().over(w))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the importance table, renumbered from 1."""
    return importance.where(F.col("rank") <= n).select("rank", "feature", "coefficient", "abs_coefficient",
                                                        "effect", "odds_ratio")


def top_signed_features(coefficients: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` by coefficient descending ('positive') and ascending ('negative')."""
    up = Window.orderBy(F.col("coefficient").desc(), F.col("feature_index"))
    down = Window.orderBy(F.col("coefficient").asc(), F.col("feature_index"))
    pos = coefficients.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= n) \
        .withColumn("side", F.lit("positive"))
    neg = coefficients.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n) \
        .withColumn("side", F.lit("negative"))
    return pos.unionByName(neg).select("side", "rank", "feature", "coefficient")


def log_odds_coefficients(encoded: DataFrame, features: list[str], label: str = config.TARGET_COL,
                          index_offset: int = 0) -> DataFrame:
    """Univariate logistic coefficients of 0/1 features, in closed form.

    For a binary feature the one-variable logistic MLE slope is the log odds
    ratio of the 2 x 2 table; 0.5 is added to every cell so empty cells stay
    finite.  One aggregate over all rows; output (feature_index, feature,
    coefficient) in the given feature order.
    """
    y = F.col(label).cast("double")
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.sum(x * y).alias(f"_a{i}"), F.sum(x * (1 - y)).alias(f"_b{i}")]
    wide = encoded.agg(*aggs)
    rows = []
    for i, f in enumerate(features):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        c = F.col("_pos") - a
        d = F.col("_n") - F.col("_pos") - b
        coef = F.log(((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)))
        rows.append(F.struct(F.lit(index_offset + i).alias("feature_index"), F.lit(f).alias("feature"),
                             coef.alias("coefficient")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
