"""Registered queries: fitted models, network inference, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash, unit_hash_sql
from ..operators import counterfactual as cf
from ..operators import explain, features, metrics, models, newton, stages
from ..session import checkpoint_dir, cut_lineage, through_files
from ..sources import io
from ..streaming import late, scoring
from . import common
from .q_explain import _BEST, _CAND, _GEN, _SCORED_C, MUT, ONE_HOT, _case_rows, _prepared, _ranges
from .registry import query
from .sql_views import dbl, register, with_views

CAT = config.FIXTURE_CATEGORICALS
SCALED = config.SCALED_COLS


def model_input(spark, sf):
    """Prepared table plus the one-hot block (levels from the training rows), written once as columns:
    fits pass over it many times and the 0/1 columns take no room."""
    enc = through_files(features.prepared_encoded(common.raw(spark, sf), CAT, keep=["id", "dataset", "status", *SCALED]), "model-input")
    names = [c for c in enc.columns if c not in ("id", "dataset", "status")]
    return enc, names


# ------------------------------------------------------------ network forward

NETWORK = models.rule_network(len(SCALED))


def _network_sql():
    """One nested SELECT a layer; unit columns are numbered per layer."""
    def affine(layer, ins, k):
        z = "(" + " + ".join(f"{c} * {dbl(layer['w'][i][k])}" for i, c in enumerate(ins)) + f" + {dbl(layer['b'][k])})"
        return f"({z} * {dbl(layer['scale'][k])} + {dbl(layer['shift'][k])})" if "scale" in layer else z

    sql, ins, depth = "prepared", SCALED, 0

    def step(layer, skip=None):
        nonlocal sql, ins, depth
        depth += 1
        outs = [f"h{depth}_{k}" for k in range(len(layer["b"]))]
        units = [f"GREATEST({affine(layer, ins, k)}{' + ' + skip[k] if skip else ''}, 0.0) AS {o}" for k, o in enumerate(outs)]
        sql, ins = f"(SELECT *, {', '.join(units)} FROM {sql})", outs

    for part in NETWORK:
        if "dense" in part:
            step(part["dense"])
        elif "block" in part:
            before = ins
            step(part["block"][0])
            step(part["block"][1], before)
    z = affine(NETWORK[-1]["output"], ins, 0)
    return f"""
SELECT id, dataset, status, p AS predicted_probability, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS INT) AS predicted_label
FROM (SELECT id, dataset, status, 1.0 / (1.0 + EXP(-({z}))) AS p FROM {sql})
"""


@query("score_network", with_views(_network_sql(), "prepared"), ["predicted_probability"])
def score_network(spark, sf):
    """Two residual blocks with a down-projection between them, weights from a saved file,
    in Arrow batches (mapInPandas, weights broadcast)."""
    path = f"{checkpoint_dir(spark)}/network-{uuid.uuid4().hex}"
    models.save_network(spark, NETWORK, path)
    p = features.prepared(common.raw(spark, sf))
    return models.score_network(p, SCALED, models.load_network(spark, path), ["id", "dataset", "status"])


# ------------------------------------------------------------- fitted models

def _train(enc):
    return enc.where(F.col("dataset") == "train")


def _logistic(enc, names):
    return models.fit_logistic(_train(enc), names, C=100.0, max_iter=1000)


NAMES = [*SCALED, *[f"{c}_{v}" for c, v in ONE_HOT]]


@query("fit_logistic", "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS feature_index, '{f}' AS feature, TRUE AS stationary" for i, f in [*enumerate(NAMES), (-1, "intercept")]))
def fit_logistic(spark, sf):
    """L2 logistic regression (C = 100, lbfgs) on the training rows, checked: at the fitted
    coefficients the gradient of the penalised loss vanishes in every direction."""
    enc, names = model_input(spark, sf)
    g = models.logistic_gradient(_train(enc), _logistic(enc, names), names, 100.0)
    return g.select("feature_index", "feature", (F.abs("gradient") < 1e-5).alias("stationary"))


@query("logistic_importance", check="R")
def logistic_importance(spark, sf):
    """G1 / E1 on the fitted logistic coefficients (names checked against them)."""
    enc, names = model_input(spark, sf)
    return explain.feature_importance(models.coefficient_table(spark, _logistic(enc, names), names))


@query("score_model", with_views("SELECT id, dataset, status, TRUE AS recomputed, TRUE AS label_ok FROM prepared", "prepared"))
def score_model(spark, sf):
    """I4: the fitted logistic model applied to every row, checked: each probability equals the
    sigmoid of the returned coefficients, each label its threshold."""
    enc, names = model_input(spark, sf)
    m = _logistic(enc, names)
    p = models.sigmoid(models.linear_logit(dict(zip(names, map(float, m.coefficients), strict=True)), float(m.intercept)))
    scored = models.score_model(m, enc.withColumn("_p", p), names, ["id", "dataset", "status", "_p"])
    close = F.abs(F.col("_p") - F.col("predicted_probability")) < 1e-9
    label = F.col("predicted_label") == (F.col("_p") >= config.DECISION_THRESHOLD).cast("int")
    return scored.select("id", "dataset", "status", close.alias("recomputed"), label.alias("label_ok"))


def _saved_and_loaded(spark, sf):
    """One folder holds preparation and classifier; nothing of the fit is used behind it."""
    path = f"{checkpoint_dir(spark)}/application-model-{uuid.uuid4().hex}"
    io.save_model(stages.fit_application_model(common.raw(spark, sf)), path)
    return io.load_pipeline_model(path)


_SAME = with_views("SELECT id, dataset, status, TRUE AS same_probability, TRUE AS same_label FROM prepared", "prepared")


def _held_against_parts(spark, sf, model, scored):
    """The loaded model's rows against the preparation and the score done step by step with its coefficients."""
    lr = next(s for s in model.stages if hasattr(s, "coefficients"))
    names = stages.feature_names(model)
    enc, _ = model_input(spark, sf)
    p = models.sigmoid(models.linear_logit(dict(zip(names, map(float, lr.coefficients), strict=True)), float(lr.intercept)))
    own = enc.select(F.col("id").alias("_id"), p.alias("_p"))
    j = scored.join(own, F.col("id") == F.col("_id"))
    return j.select("id", "dataset", "status", (F.abs(F.col("_p") - F.col("predicted_probability")) < 1e-9).alias("same_probability"),
                    (F.col("predicted_label") == (F.col("_p") >= config.DECISION_THRESHOLD).cast("int")).alias("same_label"))


@query("saved_model_scores", _SAME)
def saved_model_scores(spark, sf):
    """Preparation and classifier saved as one model, loaded, applied to raw rows."""
    model = _saved_and_loaded(spark, sf)
    return _held_against_parts(spark, sf, model, model.transform(common.raw(spark, sf)))


@query("saved_model_stream", _SAME)
def saved_model_stream(spark, sf):
    """The loaded model applied to a stream of raw rows."""
    model = _saved_and_loaded(spark, sf)
    return _held_against_parts(spark, sf, model, scoring.model_stream(spark, sf, model))


@query("model_metrics", check="R")
def model_metrics(spark, sf):
    """I1 + I3 + J10: held-out AUC-ROC, AUC-PR and Brier of the fitted logistic and MLP models."""
    enc, names = model_input(spark, sf)
    keep = ["id", "dataset", "status"]
    mlp = models.fit_mlp(_train(enc), enc.where(F.col("dataset") == "validation"), names)
    recs = models.as_prediction_records(models.score_model(_logistic(enc, names), enc, names, keep), "logistic").unionByName(
        models.as_prediction_records(models.score_model(mlp, enc, names, keep), "mlp"))
    return metrics.model_comparison(recs.where(F.col("dataset") != "train"))


@query("fit_mlp", check="R")
def fit_mlp(spark, sf):
    """I3 (re-aimed): Spark ML feed-forward classifier; validation/test metrics."""
    enc, names = model_input(spark, sf)
    mlp = models.fit_mlp(_train(enc), enc.where(F.col("dataset") == "validation"), names)
    s = models.score_model(mlp, enc, names, ["id", "dataset", "status"])
    return metrics.model_comparison(models.as_prediction_records(s, "mlp").where(F.col("dataset") != "train"))


FOLDS, GRID = 5, (0.01, 1.0, 100.0)


@query("cv_grid", with_views(f"""
SELECT f.fold, c.C, f.n, f.positives, TRUE AS stationary, TRUE AS auc_checked
FROM (SELECT CAST(LEAST(FLOOR({unit_hash_sql('id', 42)} * {FOLDS}), {FOLDS - 1}) AS INT) AS fold,
             CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(status) AS BIGINT) AS positives
      FROM prepared WHERE dataset = 'train' GROUP BY 1) f,
     (VALUES {', '.join(f'({dbl(c)})' for c in GRID)}) c(C)""", "prepared"))
def cv_grid(spark, sf):
    """5-fold grid search over C (hash folds), all fits in one batch of Newton rounds, checked: fold
    sizes and positives; the penalised loss's gradient over the other folds, by column expressions,
    vanishes; every fold's AUC against Spark ML's evaluator."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    enc, names = model_input(spark, sf)
    train = _train(enc).withColumn("fold", F.least(F.floor(unit_hash("id", 42) * FOLDS), F.lit(FOLDS - 1)).cast("int"))
    grid = newton.cv_grid(train, names, c_values=GRID, folds=FOLDS)
    ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0)
    fits, told = [p for p in grid.fits if p.left_out is not None], []
    for p in fits:
        mine = grid.scores.where((F.col("fold") == p.left_out) & (F.col("C") == p.C)).withColumn("y", F.col("y").cast("double"))
        told.append((p.left_out, p.C, float(ev.evaluate(mine))))
    told = spark.createDataFrame(told, "fold int, C double, auc double")
    flat = newton.largest_slopes(train, names, fits, label="status").select(F.col("left_out").alias("fold"), "C", (F.col("slope") < 1e-7).alias("stationary"))
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("status").cast("long")).alias("positives"))
    own = spark.createDataFrame(grid.aucs, "fold int, C double, auc_roc double")       # a row a fold and C
    return own.join(told, ["fold", "C"]).join(flat, ["fold", "C"]).join(sizes, "fold").select(
        "fold", "C", "n", "positives", "stationary", (F.abs(F.col("auc") - F.col("auc_roc")) < 1e-6).alias("auc_checked"))


# ------------------------------------------------------------------ streams

@query("stream_scores", with_views("SELECT * FROM scored", "scored"), ["predicted_probability"])
def stream_scores(spark, sf):
    """L1: applications scored as a file stream (stream-static join), equal to the batch scores."""
    prep = features.fit_prep(common.raw(spark, sf))
    return scoring.score_stream(spark, sf, prep)


@query("stream_late_customers", with_views("SELECT * FROM scored", "scored"), ["predicted_probability"])
def stream_late_customers(spark, sf):
    """L1: orders and customers both as streams that meet in state; equal to the batch scores, whichever comes first."""
    return late.late_scores(spark, sf, features.fit_prep(common.raw(spark, sf)))[0]


register("case_feats_all", "SELECT p.* FROM prepared p JOIN scored s ON p.id = s.id "
                           f"WHERE s.predicted_probability > {dbl(config.HIGH_RISK_THRESHOLD)}", ["prepared", "scored"])
register("cand_all", _CAND.replace("FROM case_feats,", "FROM case_feats_all,"), ["case_feats_all"])
register("gen_all", _GEN.replace("FROM cand c,", "FROM cand_all c,"), ["cand_all", "ranges"])
register("scored_c_all", _SCORED_C.replace("FROM gen", "FROM gen_all"), ["gen_all"])


@query("stream_counterfactuals", with_views(
    f"SELECT * FROM ({_BEST.replace('FROM scored_c ', 'FROM scored_c_all ')}) WHERE cf_no <= {config.TOTAL_CFS}",
    "scored_c_all"), ["distance", "predicted_proba", *config.MUTABLE_FEATURES])
def stream_counterfactuals(spark, sf):
    """L2: counterfactuals for every arriving application above 0.7 (foreachBatch, idempotent sink)."""
    raw = common.raw(spark, sf)
    prep = features.fit_prep(raw)
    ranges = cf.fetch_ranges(cf.feature_ranges(prep.transform(raw).where(F.col("dataset") == "train")))
    return scoring.counterfactual_stream(spark, sf, prep, ranges)


STEPS = 30
register("cfs_all", f"SELECT * FROM ({_BEST.replace('FROM scored_c ', 'FROM scored_c_all ')}) WHERE cf_no <= {config.TOTAL_CFS}", ["scored_c_all"])


def _sparse_sql() -> str:
    """One CTE a visited feature: first the whole returns, then the bisections."""
    def proba(f=None, x=None):
        z = dbl(config.SCORE_INTERCEPT)
        for name, w in config.SCORE_COEFFICIENTS.items():
            z = f"({z} + {dbl(w)} * {x if name == f else name})"
        return f"(1.0 / (1.0 + EXP(-{z})))"

    def holds(f, x):
        return f"({proba(f, x)} < {dbl(config.DECISION_THRESHOLD)})"

    views = ["s0 AS (SELECT x.*, " + ", ".join(f"o.{f} AS o_{f}" for f in MUT) + " FROM cfs_all x JOIN case_feats_all o ON x.case_id = o.id)"]
    order = cf.importance_order(MUT)
    for f in order:
        views.append(f"s{len(views)} AS (SELECT * REPLACE (CASE WHEN {holds(f, f'o_{f}')} THEN o_{f} ELSE {f} END AS {f}) FROM s{len(views) - 1})")
    for f in order:
        mid = "((s.lo + s.hi) / 2.0)"
        dummy = "{'lo': CAST(0 AS DOUBLE), 'hi': CAST(0 AS DOUBLE)}"
        fold = (f"list_reduce(list_prepend({{'lo': o_{f}, 'hi': {f}}}, list_transform(range({STEPS}), lambda i: {dummy})), "
                f"lambda s, i: CASE WHEN {holds(f, mid)} THEN {{'lo': s.lo, 'hi': {mid}}} ELSE {{'lo': {mid}, 'hi': s.hi}} END).hi")
        views.append(f"s{len(views)} AS (SELECT * REPLACE (CASE WHEN {f} = o_{f} THEN {f} WHEN {holds(f, f'o_{f}')} THEN o_{f} ELSE {fold} END AS {f}) FROM s{len(views) - 1})")
    changed = " + ".join(f"CAST({f} <> o_{f} AS INT)" for f in MUT)
    moved = " + ".join(f"COALESCE(ABS({f} - o_{f}) / NULLIF(r.{f}__max - r.{f}__min, 0), 0)" for f in MUT)
    return (f"WITH {', '.join(views)} SELECT case_id, cf_no, candidate, CAST({changed} AS INT) AS n_changed, {moved} AS distance, "
            f"{proba()} AS predicted_proba, {', '.join(MUT)} FROM s{len(views) - 1}, ranges r")


register("cfs_sparse", _sparse_sql(), ["cfs_all", "case_feats_all", "ranges"])


@query("counterfactuals_sparse", with_views("SELECT * FROM cfs_sparse", "cfs_sparse"), ["distance", "predicted_proba", *MUT])
def counterfactuals_sparse(spark, sf):
    """K3: counterfactuals of every application above 0.7, changes undone that the class does not need."""
    p = cut_lineage(_prepared(spark, sf))
    cases = cut_lineage(cf.top_cases(models.score_linear(p, keep=["id", "dataset", "status", *MUT]), None))
    ranges = _ranges(p)
    return cf.sparsify(cases.select("id", *MUT), cf.generate(cases.select("id", *MUT), ranges), ranges, steps=STEPS)


@query("counterfactuals_model", check="R")
def counterfactuals_model(spark, sf):
    """K3 for a fitted classifier: the search scored by the Spark ML logistic model, whole rows."""
    enc, names = model_input(spark, sf)
    m = _logistic(enc, names)
    keep = ["id", "dataset", "status", *names]
    cases = cut_lineage(cf.top_cases(models.score_model(m, enc, names, keep).where(F.col("dataset") == "test"), threshold=0.5))
    carry = [n for n in names if n not in MUT]

    def scorer(df):
        return models.score_model(m, df, names, df.columns).drop("predicted_label").withColumnRenamed("predicted_probability", "predicted_proba")
    return cf.generate(cases.select("id", *names), _ranges(_prepared(spark, sf)), scorer=scorer, carry=carry)
