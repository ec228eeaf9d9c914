"""Counterfactual explanations by random search, as one Spark job.

For each rejected case, ``C`` candidates are generated by exploding a
sequence on the case row (no join with a candidate table).  Candidate ``k``
changes each mutable feature with probability ``level/m`` (``level`` grows
with ``k``), drawing the new value uniformly in the feature's training
range; draws come from a keyed digest of (case_id, k), so reruns and
lost executors reproduce them.  Candidates are scored by the given scorer
(the batch scorer's linear expression by default), filtered to the desired class, and the best
``total_cfs`` per case (fewest changes, then smallest range-scaled L1 move,
then candidate number) are kept: of each batch first, where a case's candidates
lie together, so that only a few rows a case are sorted and shuffled, then with
one window partitioned by case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash
from .models import linear_logit, sigmoid


def top_cases(scored: DataFrame, n_cases: int | None = config.N_CASES,
              threshold: float = config.HIGH_RISK_THRESHOLD) -> DataFrame:
    """Whole rows with p > threshold; the top ``n_cases`` by p (all of them when None)."""
    hr = scored.where(F.col("predicted_probability") > F.lit(threshold))
    if n_cases is not None:
        hr = hr.orderBy(F.col("predicted_probability").desc(), F.col("id").asc()).limit(n_cases)
    return hr


def high_risk_cases(scored: DataFrame, n_cases: int | None = config.N_CASES,
                    threshold: float = config.HIGH_RISK_THRESHOLD) -> DataFrame:
    """``top_cases`` as test_index, predicted_proba, true_label; fewer rows when fewer qualify."""
    return top_cases(scored, n_cases, threshold).select(
        F.col("id").alias("test_index"), F.col("predicted_probability").alias("predicted_proba"),
        F.col("status").alias("true_label"))


def feature_ranges(train: DataFrame, features: list[str] = config.MUTABLE_FEATURES) -> DataFrame:
    """(feature, min, max) of each mutable feature over the training rows (one aggregate)."""
    wide = train.agg(*[a for f in features for a in (F.min(f).alias(f"{f}__min"), F.max(f).alias(f"{f}__max"))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__min").alias("min"), F.col(f"{f}__max").alias("max"))
        for f in features])).alias("r")).select("r.*")


def fetch_ranges(ranges: DataFrame, permitted: dict[str, tuple[float | None, float | None]] | None = None
                 ) -> dict[str, tuple[float, float]]:
    """The range table is one row per mutable feature: a bounded parameter set.

    ``permitted`` narrows a feature's range to user bounds (either side may
    be None); the result stays inside the training range so generated values
    remain realistic.  A bound pair that leaves no room raises ValueError.
    """
    out = {r["feature"]: (r["min"], r["max"]) for r in ranges.collect()}
    for f, (lo, hi) in (permitted or {}).items():
        if f not in out:
            raise KeyError(f"{f} is not a mutable feature")
        tlo, thi = out[f]
        nlo = tlo if lo is None else max(tlo, lo)
        nhi = thi if hi is None else min(thi, hi)
        if nlo > nhi:
            raise ValueError(f"{f}: permitted range [{lo}, {hi}] does not meet the training range")
        out[f] = (nlo, nhi)
    return out


def candidate_level(k, n_candidates: int, n_features: int):
    """How many of the m features a candidate tends to change: 1 .. m, growing with k."""
    return F.lit(1) + F.floor(k * F.lit(n_features) / F.lit(n_candidates))


def linear_scorer(coefficients: dict | None = None, intercept: float | None = None):
    """A scorer: frame with the features in, ``predicted_proba`` added."""
    coefficients = config.SCORE_COEFFICIENTS if coefficients is None else coefficients
    intercept = config.SCORE_INTERCEPT if intercept is None else intercept
    return lambda df: df.withColumn("predicted_proba", sigmoid(linear_logit(coefficients, intercept)))


def _best_of_batches(total_cfs: int, desired_class: int):
    """Of each batch a case's best usable candidates (something changed, the desired class reached).

    A candidate that is not among them is not among the case's best either, however its candidates are dealt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable = pc.and_(pc.greater(batch.column("n_changed"), 0), pc.equal(batch.column("label"), desired_class))
            batch = batch.filter(usable)                  # a null is not usable
            case = batch.column("case_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.lexsort([*(batch.column(n).to_numpy(zero_copy_only=False) for n in ("candidate", "distance", "n_changed")), case])
            case = case[order]
            yield batch.take(pa.array(order[np.arange(len(case)) - np.searchsorted(case, case) < total_cfs]))
    return run


def generate(cases: DataFrame, ranges: dict[str, tuple[float, float]], mutable: list[str] = config.MUTABLE_FEATURES,
             n_candidates: int = config.CF_CANDIDATES, total_cfs: int = config.TOTAL_CFS,
             desired_class: int = config.DESIRED_CLASS, scorer=None, carry: list[str] | None = None) -> DataFrame:
    """Counterfactuals for ``cases`` (id plus all features the scorer reads).

    ``scorer`` is any function that takes a frame with the features and adds
    ``predicted_proba``: the linear score by default, a fitted Spark ML model
    or a network as well.  ``carry`` names the features that are not mutable;
    they are copied unchanged.  With ``carry`` the output has the predicted
    ``label`` too, so that it is a whole row of the feature table.  Output:
    case_id, cf_no, candidate, n_changed, distance, predicted_proba, the
    mutable features[, carry..., label].
    """
    scorer = linear_scorer() if scorer is None else scorer
    m = len(mutable)
    rest = [c for c in cases.columns if c != "id" and c not in mutable]
    c = cases.select(F.col("id").alias("case_id"), *[F.col(f).alias(f"orig_{f}") for f in mutable], *rest,
                     F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("candidate"))
    key = ["case_id", "candidate"]
    level = candidate_level(F.col("candidate"), n_candidates, m)
    cols, changed, dist = {}, [], []
    for j, f in enumerate(mutable):
        lo, hi = ranges[f]
        span = float(hi - lo) if hi is not None and lo is not None else 0.0
        ch = unit_hash(key, config.CF_CHANGE_SALT + j) < level / F.lit(float(m))
        new = F.lit(float(lo)) + unit_hash(key, config.CF_VALUE_SALT + j) * F.lit(span)
        cols[f] = F.when(ch, new).otherwise(F.col(f"orig_{f}"))
        cols[f"_ch_{f}"] = ch.cast("int")
        changed.append(F.col(f"_ch_{f}"))
        dist.append(F.try_divide(F.abs(F.col(f) - F.col(f"orig_{f}")), F.lit(span)) if span else F.lit(0.0))
    c = c.withColumns(cols)
    c = c.withColumn("n_changed", sum(changed))
    c = c.withColumn("distance", sum(F.coalesce(d, F.lit(0.0)) for d in dist))
    c = scorer(c)
    c = c.withColumn("label", (F.col("predicted_proba") >= F.lit(config.DECISION_THRESHOLD)).cast("int"))
    c = c.select("case_id", "candidate", "n_changed", "distance", "predicted_proba", *mutable, *(carry or []), "label")
    c = c.mapInArrow(_best_of_batches(total_cfs, desired_class), c.schema)
    w = Window.partitionBy("case_id").orderBy("n_changed", "distance", "candidate")
    c = c.withColumn("cf_no", F.row_number().over(w)).where(F.col("cf_no") <= total_cfs)
    whole = [*carry, "label"] if carry is not None else []
    return c.select("case_id", "cf_no", "candidate", "n_changed", "distance", "predicted_proba", *mutable, *whole)


def linear_probability(coefficients: dict | None = None, intercept: float | None = None):
    """The linear score as a function of feature columns: {feature: Column} to Column."""
    coefficients = config.SCORE_COEFFICIENTS if coefficients is None else coefficients
    intercept = config.SCORE_INTERCEPT if intercept is None else intercept

    def score(values: dict):
        z = F.lit(float(intercept))
        for name, w in coefficients.items():
            z = z + F.lit(float(w)) * values[name]
        return sigmoid(z)
    return score


def importance_order(mutable: list[str] = config.MUTABLE_FEATURES, coefficients: dict | None = None) -> list[str]:
    """The mutable features, least important (smallest absolute coefficient, then name) first."""
    coefficients = config.SCORE_COEFFICIENTS if coefficients is None else coefficients
    return sorted(mutable, key=lambda f: (abs(coefficients.get(f, 0.0)), f))


def sparsify(cases: DataFrame, cfs: DataFrame, ranges: dict[str, tuple[float, float]], mutable: list[str] = config.MUTABLE_FEATURES,
             order: list[str] | None = None, score=None, steps: int = 30, desired_class: int = config.DESIRED_CLASS) -> DataFrame:
    """``cfs`` with changes undone that their class does not need.

    Features are visited in ``order`` (least important first), twice.  First a
    value goes back to the case's own if the class holds without the change.
    Then each value still changed moves towards it by ``steps`` bisections, a
    fold inside the row that keeps the class at its near end; the value left is
    within 2**-steps of the change from where the class would be lost.  What one
    feature's return gains is there for those behind it.  For a score that is
    monotone in every feature no changed value can be moved back any further.

    ``score`` maps {feature: Column} to the probability (the linear score by
    default) and may read the other columns of ``cases``.  A value that is null,
    or null in the case, stays as it is.  n_changed, distance and
    predicted_proba are those of the new values; candidate and cf_no stay.
    """
    order = importance_order(mutable) if order is None else order
    score = linear_probability() if score is None else score
    read = [c for c in cases.columns if c != "id" and c not in mutable and c not in cfs.columns]
    own = cases.select(F.col("id").alias("_case"), *[F.col(f).alias(f"_o_{f}") for f in mutable], *read)
    j = cfs.join(own, F.col("case_id") == F.col("_case"))

    def holds(f: str, x):
        values = {c: F.col(c) for c in [*mutable, *read]} | {f: x}
        return (score(values) >= F.lit(config.DECISION_THRESHOLD)).cast("int") == F.lit(desired_class)

    for f in order:
        j = j.withColumn(f, F.when(holds(f, F.col(f"_o_{f}")), F.col(f"_o_{f}")).otherwise(F.col(f)))
    def halving(f: str):
        def step(s, _):
            mid = (s["lo"] + s["hi"]) / F.lit(2.0)
            return F.when(holds(f, mid), F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))
        return step

    for f in order:
        start = F.struct(F.col(f"_o_{f}").alias("lo"), F.col(f).alias("hi"))
        near = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halving(f))["hi"]
        back = F.when(holds(f, F.col(f"_o_{f}")), F.col(f"_o_{f}")).otherwise(near)
        j = j.withColumn(f, F.when(F.col(f) == F.col(f"_o_{f}"), F.col(f)).otherwise(F.coalesce(back, F.col(f))))
    spans = {f: float(hi - lo) if lo is not None and hi is not None else 0.0 for f, (lo, hi) in ranges.items()}
    moves = [F.coalesce(F.try_divide(F.abs(F.col(f) - F.col(f"_o_{f}")), F.lit(spans[f])), F.lit(0.0)) for f in mutable if spans.get(f)]
    j = j.withColumns({"n_changed": sum(F.coalesce(F.col(f) != F.col(f"_o_{f}"), F.lit(False)).cast("int") for f in mutable),
                       "distance": sum(moves, F.lit(0.0)), "predicted_proba": score({c: F.col(c) for c in [*mutable, *read]})})
    return j.select(cfs.columns)


def outcome(cases: DataFrame, cfs: DataFrame) -> DataFrame:
    """Per case: number of counterfactuals found and success flag; failed cases stay."""
    n = cfs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_counterfactuals"))
    return cases.select(F.col("test_index").alias("case_id")).join(n, "case_id", "left").select(
        "case_id", F.coalesce("n_counterfactuals", F.lit(0)).cast("long").alias("n_counterfactuals"),
        (F.coalesce("n_counterfactuals", F.lit(0)) > 0).alias("success"))


def verify(cases: DataFrame, cfs: DataFrame, coefficients: dict | None = None,
           intercept: float | None = None) -> DataFrame:
    """Re-score each counterfactual; flipped = its label differs from the case's original label."""
    coefficients = config.SCORE_COEFFICIENTS if coefficients is None else coefficients
    intercept = config.SCORE_INTERCEPT if intercept is None else intercept
    rescored = cfs.select("case_id", "cf_no", sigmoid(linear_logit(coefficients, intercept)).alias("cf_proba"))
    orig = cases.select(F.col("test_index").alias("case_id"), F.col("predicted_proba").alias("original_proba"))
    j = rescored.join(orig, "case_id")
    thr = F.lit(config.DECISION_THRESHOLD)
    return j.select("case_id", "cf_no", "original_proba",
                    (F.col("original_proba") >= thr).cast("int").alias("original_pred"), "cf_proba",
                    (F.col("cf_proba") >= thr).cast("int").alias("cf_pred")).withColumn(
        "flipped", F.col("cf_pred") != F.col("original_pred"))


def flip_summary(verified: DataFrame) -> DataFrame:
    """Per case with counterfactuals: counts and flip rate (cases without any are absent)."""
    return verified.groupBy("case_id").agg(
        F.first("original_proba").alias("original_proba"), F.first("original_pred").alias("original_pred"),
        F.count(F.lit(1)).alias("num_counterfactuals"), F.count_if("flipped").alias("num_flipped")
    ).withColumn("flip_rate", F.coalesce(F.try_divide(F.col("num_flipped").cast("double"),
                                                      F.col("num_counterfactuals").cast("double")), F.lit(0.0))) \
        .withColumnRenamed("case_id", "case_index")


def deltas(cases_features: DataFrame, cfs: DataFrame, mutable: list[str] = config.MUTABLE_FEATURES) -> DataFrame:
    """(case_id, cf_no, feature, original, counterfactual, delta) for changed features only."""
    orig = cases_features.select(F.col("id").alias("case_id"), *[F.col(f).alias(f"o_{f}") for f in mutable])
    j = cfs.join(orig, "case_id")
    long = j.select("case_id", "cf_no", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"o_{f}").alias("original"), F.col(f).alias("counterfactual"))
        for f in mutable])).alias("d")).select("case_id", "cf_no", "d.*")
    return long.withColumn("delta", F.col("counterfactual") - F.col("original")).where(F.col("delta") != 0)


def change_frequency(delta_table: DataFrame) -> DataFrame:
    return delta_table.groupBy("feature").agg(F.count(F.lit(1)).alias("n_changes"))
