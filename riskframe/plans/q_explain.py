"""Registered queries: coefficient explanations and counterfactuals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash_sql
from ..operators import counterfactual as cf
from ..operators import explain, features, models
from ..session import checkpoint_dir, cut_lineage
from ..sources import cases as store
from . import common
from . import q_metrics  # noqa: F401  (registers the "scored" view used below)
from .q_cleaning import FIXTURE_LEVELS
from .registry import query
from .sql_views import dbl, register, with_views

CAT = config.FIXTURE_CATEGORICALS
SCALED = config.SCALED_COLS
MUT = config.MUTABLE_FEATURES
ONE_HOT = [(c, v) for c in CAT for v in FIXTURE_LEVELS[c]]


# ----------------------------------------------------------------- oracle SQL

def _encoded_sql():
    cols = ", ".join(f"CASE WHEN {c} = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"{c}_{v}\""
                     for c, v in ONE_HOT)
    return f"SELECT status, {cols} FROM prepared WHERE dataset = 'train'"


def _coef_sql():
    aggs = ["CAST(COUNT(*) AS BIGINT) AS _n", "SUM(CAST(status AS DOUBLE)) AS _pos"]
    for i, (c, v) in enumerate(ONE_HOT):
        x = f'"{c}_{v}"'
        aggs += [f"SUM({x} * CAST(status AS DOUBLE)) AS _a{i}", f"SUM({x} * (1 - CAST(status AS DOUBLE))) AS _b{i}"]
    rows = []
    for i, (c, v) in enumerate(ONE_HOT):
        a, b = f"_a{i}", f"_b{i}"
        cc, d = f"(_pos - {a})", f"((_n - _pos) - {b})"
        rows.append(f"SELECT {len(SCALED) + i} AS feature_index, '{c}_{v}' AS feature, "
                    f"LN((({a} + 0.5) * ({d} + 0.5)) / (({b} + 0.5) * ({cc} + 0.5))) AS coefficient FROM coef_w")
    return f"SELECT {', '.join(aggs)} FROM encoded_train", "\nUNION ALL ".join(rows)


register("encoded_train", _encoded_sql(), ["prepared"])
_CW, _CROWS = _coef_sql()
register("coef_w", _CW, ["encoded_train"])
register("coefficients", _CROWS, ["coef_w"])
register("importance", f"""
SELECT feature_index, feature, coefficient, ABS(coefficient) AS abs_coefficient,
       CASE WHEN coefficient >= 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS effect,
       EXP(LEAST(GREATEST(coefficient, {dbl(-config.ODDS_CLIP)}), {dbl(config.ODDS_CLIP)})) AS odds_ratio,
       CAST(ROW_NUMBER() OVER (ORDER BY ABS(coefficient) DESC, feature_index) AS INT) AS rank
FROM coefficients""", ["coefficients"])

register("cases", f"""
SELECT id AS test_index, predicted_probability AS predicted_proba, status AS true_label FROM scored
WHERE dataset = 'test' AND predicted_probability > {dbl(config.HIGH_RISK_THRESHOLD)}
ORDER BY predicted_probability DESC, id LIMIT {config.N_CASES}""", ["scored"])
register("ranges", "SELECT " + ", ".join(f"MIN({f}) AS {f}__min, MAX({f}) AS {f}__max" for f in MUT)
         + " FROM prepared WHERE dataset = 'train'", ["prepared"])
register("case_feats", "SELECT p.* FROM prepared p JOIN cases c ON p.id = c.test_index", ["prepared", "cases"])


def _logit(cols):
    z = dbl(config.SCORE_INTERCEPT)
    for c, w in config.SCORE_COEFFICIENTS.items():
        z = f"({z} + {dbl(w)} * {cols.get(c, c)})"
    return f"1.0 / (1.0 + EXP(-{z}))"


def _gen_sql():
    C, m = config.CF_CANDIDATES, len(MUT)
    key = ["c.case_id", "c.candidate"]
    level = f"(1 + FLOOR(c.candidate * {m} / {C}))"
    sel, ch, dist = [], [], []
    for j, f in enumerate(MUT):
        lo, hi = f"r.{f}__min", f"r.{f}__max"
        change = f"({unit_hash_sql(key, config.CF_CHANGE_SALT + j)} < {level} / CAST({m} AS DOUBLE))"
        new = f"({lo} + {unit_hash_sql(key, config.CF_VALUE_SALT + j)} * ({hi} - {lo}))"
        sel.append(f"CASE WHEN {change} THEN {new} ELSE c.orig_{f} END AS {f}")
        sel.append(f"CAST(CASE WHEN {change} THEN 1 ELSE 0 END AS INT) AS _ch_{f}")
        dist.append(f"COALESCE(ABS({f} - orig_{f}) / NULLIF({f}__max - {f}__min, 0), 0.0)")
    cand = ("SELECT id AS case_id, CAST(k AS INT) AS candidate, "
            + ", ".join(f"{f} AS orig_{f}" for f in MUT) + f" FROM case_feats, range({C}) t(k)")
    gen = f"SELECT c.*, r.*, {', '.join(sel)} FROM cand c, ranges r"
    scored_c = (f"SELECT *, CAST({' + '.join('_ch_' + f for f in MUT)} AS INT) AS n_changed, "
                f"0 + {' + '.join(dist)} AS distance, "
                f"CAST({_logit({})} AS DOUBLE) AS predicted_proba FROM gen")
    best = (f"SELECT case_id, CAST(ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY n_changed, distance, candidate) "
            f"AS INT) AS cf_no, candidate, n_changed, distance, predicted_proba, {', '.join(MUT)} FROM scored_c "
            f"WHERE n_changed > 0 AND predicted_proba < {dbl(config.DECISION_THRESHOLD)}")
    return cand, gen, scored_c, best


_CAND, _GEN, _SCORED_C, _BEST = _gen_sql()
register("cand", _CAND, ["case_feats"])
register("gen", _GEN, ["cand", "ranges"])
register("scored_c", _SCORED_C, ["gen"])
register("cfs", f"SELECT * FROM ({_BEST}) WHERE cf_no <= {config.TOTAL_CFS}", ["scored_c"])
register("verified", f"""
SELECT v.case_id, v.cf_no, c.predicted_proba AS original_proba,
       CAST(CASE WHEN c.predicted_proba >= 0.5 THEN 1 ELSE 0 END AS INT) AS original_pred,
       v.cf_proba, CAST(CASE WHEN v.cf_proba >= 0.5 THEN 1 ELSE 0 END AS INT) AS cf_pred,
       (CASE WHEN v.cf_proba >= 0.5 THEN 1 ELSE 0 END) <> (CASE WHEN c.predicted_proba >= 0.5 THEN 1 ELSE 0 END) AS flipped
FROM (SELECT case_id, cf_no, CAST({_logit({})} AS DOUBLE) AS cf_proba FROM cfs) v
JOIN cases c ON v.case_id = c.test_index""", ["cfs", "cases"])
register("summary", """
SELECT case_id AS case_index, MAX(original_proba) AS original_proba, MAX(original_pred) AS original_pred,
       CAST(COUNT(*) AS BIGINT) AS num_counterfactuals, CAST(COUNT_IF(flipped) AS BIGINT) AS num_flipped,
       CAST(COUNT_IF(flipped) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS flip_rate
FROM verified GROUP BY case_id""", ["verified"])
register("deltas", "\nUNION ALL ".join(
    f"SELECT x.case_id, x.cf_no, '{f}' AS feature, o.{f} AS original, x.{f} AS counterfactual, x.{f} - o.{f} AS delta "
    f"FROM cfs x JOIN case_feats o ON x.case_id = o.id WHERE x.{f} - o.{f} <> 0" for f in MUT),
    ["cfs", "case_feats"])


# ---------------------------------------------------------------- Spark side

def coefficients(spark, sf):
    enc = features.prepared_encoded(common.raw(spark, sf), CAT, keep=["status", "dataset"]).where(
        F.col("dataset") == "train").drop("dataset")
    names = [c for c in enc.columns if c != "status"]
    return explain.log_odds_coefficients(enc, names, index_offset=len(SCALED))


@query("log_odds_coefficients", with_views("SELECT * FROM coefficients", "coefficients"), ["coefficient"])
def log_odds_coefficients(spark, sf):
    """Coefficient table from the data: univariate logistic slopes of the one-hot features (train rows)."""
    return coefficients(spark, sf)


@query("feature_importance", with_views("SELECT * FROM importance", "importance"),
       ["coefficient", "abs_coefficient", "odds_ratio"])
def feature_importance(spark, sf):
    """Names joined to coefficients, abs, effect, clipped odds ratio, rank by |coefficient|."""
    c = cut_lineage(coefficients(spark, sf))
    names = spark.createDataFrame([(len(SCALED) + i, f"{a}_{v}") for i, (a, v) in enumerate(ONE_HOT)], "feature_index int, feature string")
    return explain.feature_importance(explain.pair_names(names, c))


@query("top_features", with_views(
    "SELECT rank, feature, coefficient, abs_coefficient, effect, odds_ratio FROM importance WHERE rank <= 10",
    "importance"), ["coefficient", "abs_coefficient", "odds_ratio"])
def top_features(spark, sf):
    """Top-10 by |coefficient|, renumbered."""
    return explain.top_features(explain.feature_importance(coefficients(spark, sf)), 10)


@query("top_signed_features", with_views("""
SELECT side, rank, feature, coefficient FROM (
  SELECT 'positive' AS side, CAST(ROW_NUMBER() OVER (ORDER BY coefficient DESC, feature_index) AS INT) AS rank,
         feature, coefficient FROM coefficients
  UNION ALL
  SELECT 'negative', CAST(ROW_NUMBER() OVER (ORDER BY coefficient ASC, feature_index) AS INT), feature, coefficient
  FROM coefficients) WHERE rank <= 5""", "coefficients"), ["coefficient"])
def top_signed_features(spark, sf):
    """Top-5 positive and top-5 negative coefficients."""
    return explain.top_signed_features(coefficients(spark, sf), 5)


def _prepared(spark, sf):
    return features.prepared(common.raw(spark, sf))


def _cases_from(p):
    return cf.high_risk_cases(models.score_linear(p).where(F.col("dataset") == "test"))


def _cases(spark, sf):
    return _cases_from(_prepared(spark, sf))


def _case_rows(p):
    """The top cases with every feature: they ride through the limit, nothing is joined back."""
    scored = models.score_linear(p, keep=["id", "dataset", "status", *SCALED, *CAT])
    return cut_lineage(cf.top_cases(scored.where(F.col("dataset") == "test")))


def _ranges(p, permitted=None):
    return cf.fetch_ranges(cf.feature_ranges(p.where(F.col("dataset") == "train")), permitted)


def _cf_parts(spark, sf):
    p = _prepared(spark, sf)
    case_feats = _case_rows(p)      # a row a case
    cases = cf.high_risk_cases(case_feats, None)
    return cases, case_feats, cf.generate(case_feats, _ranges(p))


@query("high_risk_cases", with_views("SELECT * FROM cases", "cases"), ["predicted_proba"])
def high_risk_cases(spark, sf):
    """Test rows with p > 0.7, top 3 by p."""
    return _cases(spark, sf)


@query("feature_ranges", with_views("\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, {f}__min AS min, {f}__max AS max FROM ranges" for f in MUT), "ranges"), ["min", "max"])
def feature_ranges(spark, sf):
    """K2: training range of each mutable feature."""
    return cf.feature_ranges(_prepared(spark, sf).where(F.col("dataset") == "train"))


@query("counterfactuals", with_views("SELECT * FROM cfs", "cfs"), ["distance", "predicted_proba", *MUT])
def counterfactuals(spark, sf):
    """Random-search counterfactuals, at most 3 per case, desired class 0."""
    return _cf_parts(spark, sf)[2]


@query("cf_outcome", with_views("""
SELECT c.test_index AS case_id, CAST(COALESCE(n.k, 0) AS BIGINT) AS n_counterfactuals, COALESCE(n.k, 0) > 0 AS success
FROM cases c LEFT JOIN (SELECT case_id, COUNT(*) AS k FROM cfs GROUP BY case_id) n ON c.test_index = n.case_id
""", "cases", "cfs"))
def cf_outcome(spark, sf):
    """K4: per case, counterfactual count and success flag (failed cases stay visible)."""
    cases, _, cfs = _cf_parts(spark, sf)
    return cf.outcome(cases, cfs)


@query("verify_counterfactuals", with_views("SELECT * FROM verified", "verified"), ["original_proba", "cf_proba"])
def verify_counterfactuals(spark, sf):
    """Re-score each counterfactual; flipped = label differs from the original label."""
    cases, _, cfs = _cf_parts(spark, sf)
    return cf.verify(cases, cfs)


@query("flip_summary", with_views("SELECT * FROM summary", "summary"), ["original_proba", "flip_rate"])
def flip_summary(spark, sf):
    """K6 / C17: per-case flip counts and rate; cases without counterfactuals omitted."""
    cases, _, cfs = _cf_parts(spark, sf)
    return cf.flip_summary(cf.verify(cases, cfs))


@query("flip_rate_overall", with_views(
    "SELECT CAST(COUNT(*) AS BIGINT) AS n_cases, AVG(flip_rate) AS mean_flip_rate FROM summary", "summary"),
    ["mean_flip_rate"])
def flip_rate_overall(spark, sf):
    """K6: number of explained cases and their mean flip rate."""
    cases, _, cfs = _cf_parts(spark, sf)
    s = cf.flip_summary(cf.verify(cases, cfs))
    return s.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("flip_rate").alias("mean_flip_rate"))


@query("cf_deltas", with_views("SELECT * FROM deltas", "deltas"), ["original", "counterfactual", "delta"])
def cf_deltas(spark, sf):
    """K7: original vs counterfactual value of each changed feature."""
    _, case_feats, cfs = _cf_parts(spark, sf)
    return cf.deltas(case_feats, cfs)


@query("cf_change_frequency", with_views(
    "SELECT feature, CAST(COUNT(*) AS BIGINT) AS n_changes FROM deltas GROUP BY feature", "deltas"))
def cf_change_frequency(spark, sf):
    """K8: how often each mutable feature is changed across all counterfactuals."""
    _, case_feats, cfs = _cf_parts(spark, sf)
    return cf.change_frequency(cf.deltas(case_feats, cfs))


#: Features that the search leaves alone, in the order of the feature table.
CARRIED = [c for c in SCALED if c not in MUT] + CAT
register("cfs_full", "SELECT x.*, " + ", ".join(f"o.{c}" for c in CARRIED) + ", CAST(0 AS INT) AS label "
         "FROM cfs x JOIN case_feats o ON x.case_id = o.id", ["cfs", "case_feats"])


@query("counterfactuals_full", with_views("SELECT * FROM cfs_full", "cfs_full"), ["distance", "predicted_proba", *MUT, "year"])
def counterfactuals_full(spark, sf):
    """K3: whole counterfactual rows, every feature and the label, immutable ones copied."""
    p = _prepared(spark, sf)
    return cf.generate(_case_rows(p), _ranges(p), carry=CARRIED)


#: User bounds of the permitted-range query, in standard deviations.
PERMITTED = {"loan_amount": (-1.0, 0.5), "income": (None, 1.0), "ltv": (-0.5, None)}
register("ranges_permitted", "SELECT " + ", ".join(
    f"GREATEST({f}__min, {dbl(PERMITTED.get(f, (None, None))[0])}) AS {f}__min" if PERMITTED.get(f, (None, None))[0] is not None else f"{f}__min"
    for f in MUT) + ", " + ", ".join(
    f"LEAST({f}__max, {dbl(PERMITTED.get(f, (None, None))[1])}) AS {f}__max" if PERMITTED.get(f, (None, None))[1] is not None else f"{f}__max"
    for f in MUT) + " FROM ranges", ["ranges"])
register("gen_permitted", _GEN.replace("ranges r", "ranges_permitted r"), ["cand", "ranges_permitted"])
register("scored_c_permitted", _SCORED_C.replace("FROM gen", "FROM gen_permitted"), ["gen_permitted"])


@query("counterfactuals_permitted", with_views(
    f"SELECT * FROM ({_BEST.replace('FROM scored_c ', 'FROM scored_c_permitted ')}) WHERE cf_no <= {config.TOTAL_CFS}",
    "scored_c_permitted"), ["distance", "predicted_proba", *MUT])
def counterfactuals_permitted(spark, sf):
    """K9: the search inside user bounds, cut to the training range."""
    p = _prepared(spark, sf)
    return cf.generate(_case_rows(p), _ranges(p, PERMITTED))


register("case_rows_all", "\nUNION ALL ".join(
    f"SELECT p.id AS case_id, '{f}' AS feature, p.{f} AS value, s.predicted_probability AS predicted_proba FROM prepared p JOIN scored s ON p.id = s.id "
    f"WHERE s.dataset = 'test' AND s.predicted_probability > {dbl(config.HIGH_RISK_THRESHOLD)}" for f in MUT), ["prepared", "scored"])


@query("case_store", with_views("SELECT * FROM case_rows_all", "case_rows_all"), ["value", "predicted_proba"])
def case_store(spark, sf):
    """A6 for every high-risk case: a row a feature, written to the per-case store and read back."""
    scored = models.score_linear(_prepared(spark, sf), keep=["id", "dataset", *MUT])
    high = cf.top_cases(scored.where(F.col("dataset") == "test"), None)
    rows = high.select(F.col("id").alias("case_id"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in MUT])).alias("f"), F.col("predicted_probability").alias("predicted_proba"))
    path = f"{checkpoint_dir(spark)}/cases-{uuid.uuid4().hex}"
    store.write_cases(rows.select("case_id", "f.*", "predicted_proba"), path, "case_id")
    return store.read_cases(spark, path)
