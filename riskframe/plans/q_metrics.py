"""Registered queries: evaluation of scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import features, metrics, models
from ..sources import tables
from . import common
from .registry import query
from .sql_views import calibration_bin_sql, dbl, register, with_views

register("cum", """
SELECT model, dataset, p, pos, neg,
  CAST(SUM(pos) OVER w AS BIGINT) AS tps, CAST(SUM(neg) OVER w AS BIGINT) AS fps,
  CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn,
  CAST(SUM(pos) OVER (PARTITION BY model, dataset) AS BIGINT) AS tot_pos,
  CAST(SUM(neg) OVER (PARTITION BY model, dataset) AS BIGINT) AS tot_neg
FROM (SELECT model, dataset, p, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg
      FROM pred_long GROUP BY model, dataset, p)
WINDOW w AS (PARTITION BY model, dataset ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""", ["pred_long"])

_AUC = ("CAST(SUM(neg * (CAST(tps AS DOUBLE) - CAST(pos AS DOUBLE) / 2)) AS DOUBLE) / "
        "(CAST(MAX(tot_pos) AS DOUBLE) * CAST(MAX(tot_neg) AS DOUBLE))")
_AP = "SUM(CAST(pos AS DOUBLE) * CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE)) / CAST(MAX(tot_pos) AS DOUBLE)"
_BRIER = "AVG(POWER(p - y, 2))"

register("auc_tbl", f"SELECT model, dataset, {_AUC} AS auc_roc, {_AP} AS auc_pr FROM cum GROUP BY model, dataset",
         ["cum"])
register("comparison", f"""
SELECT a.model, a.dataset, a.auc_roc, a.auc_pr, b.brier_score
FROM auc_tbl a JOIN (SELECT model, dataset, {_BRIER} AS brier_score FROM pred_long GROUP BY model, dataset) b
  ON a.model = b.model AND a.dataset = b.dataset
""", ["auc_tbl", "pred_long"])


def _pred(spark, sf):
    return common.pred_long(spark, sf)


@query("align_predictions", with_views("SELECT id, dataset, true_label, p_a, p_b FROM predictions", "predictions"))
def align_predictions(spark, sf):
    """Zip two models' predictions with the labels by id (inner equi-join)."""
    pl = _pred(spark, sf)
    a = pl.where(F.col("model") == "a").select("id", "dataset", F.col("y").alias("true_label"), F.col("p").alias("p_a"))
    b = pl.where(F.col("model") == "b").select("id", F.col("p").alias("p_b"))
    return a.join(b, "id")


@query("class_balance", with_views(
    "SELECT CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(Status) AS BIGINT) AS positives, "
    "AVG(CAST(Status AS DOUBLE)) AS positive_rate FROM raw_applications", "raw_applications"), ["positive_rate"])
def class_balance(spark, sf):
    """Positive count and rate (the no-skill PR baseline)."""
    r = common.raw(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("Status").cast("long")).alias("positives"),
                  F.avg(F.col("Status").cast("double")).alias("positive_rate"))


@query("roc_auc", with_views(f"SELECT model, dataset, {_AUC} AS auc_roc FROM cum GROUP BY model, dataset", "cum"),
       ["auc_roc"])
def roc_auc(spark, sf):
    """ROC AUC per model and dataset, ties count one half."""
    return metrics.roc_auc(_pred(spark, sf))


@query("average_precision", with_views(
    f"SELECT model, dataset, {_AP} AS average_precision FROM cum GROUP BY model, dataset", "cum"),
    ["average_precision"])
def average_precision(spark, sf):
    """Step-wise average precision."""
    return metrics.average_precision(_pred(spark, sf))


@query("brier_score", with_views(
    f"SELECT model, dataset, {_BRIER} AS brier_score FROM pred_long GROUP BY model, dataset", "pred_long"),
    ["brier_score"])
def brier_score(spark, sf):
    """Mean squared error of the probability."""
    return metrics.brier_score(_pred(spark, sf))


@query("roc_curve", with_views("""
SELECT model, dataset, p AS threshold, CAST(fps AS DOUBLE) / CAST(tot_neg AS DOUBLE) AS fpr,
       CAST(tps AS DOUBLE) / CAST(tot_pos AS DOUBLE) AS tpr
FROM (SELECT *, LEAD(pos) OVER (PARTITION BY model, dataset ORDER BY rn) AS next_pos,
                LEAD(neg) OVER (PARTITION BY model, dataset ORDER BY rn) AS next_neg FROM cum)
WHERE rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL
SELECT model, dataset, CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
FROM cum WHERE rn = 1
""", "cum"), ["fpr", "tpr"])
def roc_curve(spark, sf):
    """ROC points, collinear interior points dropped, origin at +inf."""
    return metrics.roc_curve(_pred(spark, sf))


@query("pr_curve", with_views("""
SELECT model, dataset, p AS threshold,
       COALESCE(CAST(tps AS DOUBLE) / NULLIF(CAST(tps + fps AS DOUBLE), 0), CAST(0 AS DOUBLE)) AS precision,
       CASE WHEN tot_pos = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(tps AS DOUBLE) / CAST(tot_pos AS DOUBLE) END AS recall
FROM cum
UNION ALL
SELECT model, dataset, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM cum WHERE rn = 1
""", "cum"), ["precision", "recall"])
def pr_curve(spark, sf):
    """Precision-recall at every threshold plus the final (1, 0) point."""
    return metrics.pr_curve(_pred(spark, sf))


_AREA = """
SELECT model, dataset, curve, area FROM (
  SELECT model, dataset,
    SUM(((CAST(fps AS DOUBLE) - pf) * (CAST(tps AS DOUBLE) + pt) / 2.0)
        / (CAST(tot_pos AS DOUBLE) * CAST(tot_neg AS DOUBLE))) AS roc,
    SUM(((CAST(tps AS DOUBLE) - pt) * (COALESCE(CAST(tps AS DOUBLE) / NULLIF(CAST(tps AS DOUBLE) + CAST(fps AS DOUBLE), 0), 0.0)
          + pp) / 2.0) / CAST(tot_pos AS DOUBLE)) AS pr
  FROM (SELECT *,
          COALESCE(CAST(LAG(tps) OVER w AS DOUBLE), 0.0) AS pt,
          COALESCE(CAST(LAG(fps) OVER w AS DOUBLE), 0.0) AS pf,
          CASE WHEN LAG(tps) OVER w IS NULL THEN 1.0
               ELSE COALESCE(CAST(LAG(tps) OVER w AS DOUBLE)
                             / NULLIF(CAST(LAG(tps) OVER w AS DOUBLE) + CAST(LAG(fps) OVER w AS DOUBLE), 0), 0.0) END AS pp
        FROM cum WINDOW w AS (PARTITION BY model, dataset ORDER BY rn))
  GROUP BY model, dataset)
UNPIVOT (area FOR curve IN (roc, pr))
"""


@query("curve_area", with_views(_AREA, "cum"), ["area"])
def curve_area(spark, sf):
    """Trapezoid area under the ROC and the precision-recall curves."""
    return metrics.curve_area(_pred(spark, sf))


@query("calibration", with_views(
    f"SELECT model, dataset, CAST({calibration_bin_sql()} AS INT) AS bin, CAST(COUNT(*) AS BIGINT) AS n, "
    "AVG(CAST(y AS DOUBLE)) AS prob_true, AVG(p) AS prob_pred FROM pred_long GROUP BY ALL", "pred_long"),
    ["prob_true", "prob_pred"])
def calibration(spark, sf):
    """10 uniform bins, edge values to the lower bin, empty bins dropped."""
    return metrics.calibration(_pred(spark, sf))


def histogram_sql(src: str, groups: list[str], value: str, n_bins: int) -> str:
    g = ", ".join(groups)
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM r.{c}" for c in groups)
    return f"""
WITH rng AS (
  SELECT {g}, CASE WHEN MIN({value}) = MAX({value}) THEN MIN({value}) - 0.5 ELSE MIN({value}) END AS lo,
         CASE WHEN MIN({value}) = MAX({value}) THEN MAX({value}) + 0.5 ELSE MAX({value}) END AS hi
  FROM {src} WHERE {value} IS NOT NULL GROUP BY {g}),
cnt AS (
  SELECT {', '.join('r.' + c for c in groups)},
         CAST(LEAST(FLOOR((s.{value} - r.lo) / (r.hi - r.lo) * {n_bins}), {n_bins - 1}) AS INT) AS bin,
         CAST(COUNT(*) AS BIGINT) AS n
  FROM {src} s JOIN rng r ON {on} WHERE s.{value} IS NOT NULL GROUP BY ALL),
grid AS (SELECT {g}, lo, hi, CAST(b AS INT) AS bin FROM rng, range({n_bins}) t(b))
SELECT {', '.join('g.' + c for c in groups)}, g.bin,
       g.lo + g.bin * ((g.hi - g.lo) / {float(n_bins)}) AS bin_lo,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / {float(n_bins)}) AS bin_hi,
       COALESCE(c.n, 0) AS count
FROM grid g LEFT JOIN cnt c ON {' AND '.join(f'g.{c} IS NOT DISTINCT FROM c.{c}' for c in groups)} AND g.bin = c.bin
"""


@query("score_histogram", with_views(
    "SELECT * FROM hist_src_hist",
    "pred_long", extra={"hist_src": "SELECT model, dataset, y AS label, p FROM pred_long",
                        "hist_src_hist": "SELECT * FROM (" + histogram_sql(
                            "hist_src", ["model", "dataset", "label"], "p", 50) + ")"}),
    ["bin_lo", "bin_hi"])
def score_histogram(spark, sf):
    """Score histogram per model, dataset and true class; 50 bins over the class's own range."""
    return metrics.score_histogram(_pred(spark, sf))


_CM = ("SELECT model, dataset, CAST(COUNT_IF(y = 0 AND p < 0.5) AS BIGINT) AS tn, "
       "CAST(COUNT_IF(y = 0 AND p >= 0.5) AS BIGINT) AS fp, CAST(COUNT_IF(y = 1 AND p < 0.5) AS BIGINT) AS fn, "
       "CAST(COUNT_IF(y = 1 AND p >= 0.5) AS BIGINT) AS tp FROM pred_long GROUP BY model, dataset")
register("cm", _CM, ["pred_long"])


@query("confusion_matrix", with_views("SELECT * FROM cm", "cm"))
def confusion_matrix(spark, sf):
    """Confusion counts at p >= 0.5."""
    return metrics.confusion_matrix(_pred(spark, sf))


def _r(a, b):
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"


_REPORT = f"""
SELECT model, dataset, class_label, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM (
  SELECT model, dataset, '0' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m
  UNION ALL SELECT model, dataset, '1', p1, r1, f1, s1 FROM m
  UNION ALL SELECT model, dataset, 'accuracy', NULL, NULL, acc, tot FROM m
  UNION ALL SELECT model, dataset, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot FROM m
  UNION ALL SELECT model, dataset, 'weighted avg', {_r('p0 * s0 + p1 * s1', 'tot')}, {_r('r0 * s0 + r1 * s1', 'tot')},
                   {_r('f0 * s0 + f1 * s1', 'tot')}, tot FROM m)
"""
_M = f"""
SELECT model, dataset, p0, r0, {_r('2 * p0 * r0', 'p0 + r0')} AS f0, s0, p1, r1, {_r('2 * p1 * r1', 'p1 + r1')} AS f1, s1,
       acc, tot
FROM (SELECT model, dataset, {_r('tn', 'tn + fn')} AS p0, {_r('tn', 'tn + fp')} AS r0, tn + fp AS s0,
             {_r('tp', 'tp + fp')} AS p1, {_r('tp', 'tp + fn')} AS r1, tp + fn AS s1,
             {_r('tp + tn', 'tn + fp + fn + tp')} AS acc, tn + fp + fn + tp AS tot FROM cm)
"""


@query("classification_report", with_views(_REPORT, "cm", extra={"m": _M}), ["precision", "recall", "f1_score"])
def classification_report(spark, sf):
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    return metrics.classification_report(_pred(spark, sf))


@query("model_comparison", with_views("SELECT * FROM comparison", "comparison"), ["auc_roc", "auc_pr", "brier_score"])
def model_comparison(spark, sf):
    """Model x dataset table of AUC-ROC, AUC-PR and Brier score."""
    return metrics.model_comparison(_pred(spark, sf))


@query("best_model", with_views(
    "SELECT model, auc_roc FROM comparison WHERE dataset = 'validation' ORDER BY auc_roc DESC, model LIMIT 1",
    "comparison"), ["auc_roc"])
def best_model(spark, sf):
    """The model with the best validation AUC-ROC."""
    return metrics.best_model(metrics.model_comparison(_pred(spark, sf)))


@query("auc_gain", with_views("""
SELECT dataset, base_auc, other_auc, (other_auc - base_auc) / base_auc * 100.0 AS gain_pct FROM (
  SELECT dataset, MAX(CASE WHEN model = 'a' THEN auc_roc END) AS base_auc,
         MAX(CASE WHEN model = 'b' THEN auc_roc END) AS other_auc FROM comparison GROUP BY dataset)
""", "comparison"), ["base_auc", "other_auc", "gain_pct"])
def auc_gain(spark, sf):
    """Relative AUC-ROC gain of model b over model a, percent."""
    return metrics.auc_gain(metrics.model_comparison(_pred(spark, sf)), "a", "b")


@query("focal_loss", with_views(f"""
SELECT model, dataset, AVG({config.FOCAL_ALPHA} * POWER(1 - EXP(-bce), {config.FOCAL_GAMMA}) * bce) AS focal_loss
FROM (SELECT model, dataset,
        CASE WHEN q <= 0 THEN CAST({config.BCE_CLAMP} AS DOUBLE) ELSE LEAST(-LN(q), {dbl(config.BCE_CLAMP)}) END AS bce
      FROM (SELECT model, dataset, CASE WHEN y = 1 THEN p ELSE 1 - p END AS q FROM pred_long))
GROUP BY model, dataset
""", "pred_long"), ["focal_loss"])
def focal_loss(spark, sf):
    """Mean focal loss (alpha 0.25, gamma 2, BCE clamped at 100)."""
    return metrics.focal_loss(_pred(spark, sf))


def _logit_sql():
    z = dbl(config.SCORE_INTERCEPT)
    for c, w in config.SCORE_COEFFICIENTS.items():
        z = f"({z} + {dbl(w)} * {c})"
    return f"1.0 / (1.0 + EXP(-{z}))"


register("scored", f"""
SELECT id, dataset, status, p AS predicted_probability, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS INT) AS predicted_label
FROM (SELECT id, dataset, status, CAST({_logit_sql()} AS DOUBLE) AS p FROM prepared)
""", ["prepared"])


def scored(spark, sf):
    return models.score_linear(features.prepared(common.raw(spark, sf)))


@query("score_linear", with_views("SELECT * FROM scored", "scored"), ["predicted_probability"])
def score_linear(spark, sf):
    """Linear score on standardised features, probability and 0.5-threshold label."""
    return scored(spark, sf)


@query("scored_metrics", with_views("""
SELECT s.dataset, s.auc_roc, s.auc_pr, b.brier_score FROM (
  SELECT dataset, {auc} AS auc_roc, {ap} AS auc_pr FROM (
    SELECT dataset, p, pos, neg,
      CAST(SUM(pos) OVER w AS BIGINT) AS tps, CAST(SUM(neg) OVER w AS BIGINT) AS fps,
      CAST(SUM(pos) OVER (PARTITION BY dataset) AS BIGINT) AS tot_pos,
      CAST(SUM(neg) OVER (PARTITION BY dataset) AS BIGINT) AS tot_neg
    FROM (SELECT dataset, predicted_probability AS p, CAST(SUM(status) AS BIGINT) AS pos,
                 CAST(SUM(1 - status) AS BIGINT) AS neg FROM scored GROUP BY dataset, predicted_probability)
    WINDOW w AS (PARTITION BY dataset ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  GROUP BY dataset) s
JOIN (SELECT dataset, AVG(POWER(predicted_probability - status, 2)) AS brier_score FROM scored GROUP BY dataset) b
  ON s.dataset = b.dataset
""".format(auc=_AUC, ap=_AP), "scored"), ["auc_roc", "auc_pr", "brier_score"])
def scored_metrics(spark, sf):
    """I4 + J1-J3 end to end: the linear model's AUC-ROC, AUC-PR and Brier per split."""
    s = scored(spark, sf)
    pred = s.select("dataset", F.col("status").alias("y"), F.col("predicted_probability").alias("p"))
    return metrics.model_comparison(pred, ["dataset"])
