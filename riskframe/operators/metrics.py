"""Evaluation of scored tables: ranking metrics, curves, calibration, reports.

Input is a prediction table with columns (<keys>, y, p): keys are usually
(model, dataset).  Everything that needs the score order starts from one
pre-aggregation ``groupBy(keys, p)`` (tied scores become one row, which also
removes any hot-score skew) and then uses bucketed running totals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import cut_lineage
from .running import join_on, running_totals

KEYS = ["model", "dataset"]


def score_groups(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, p, pos, neg): label counts per distinct score."""
    return pred.groupBy(*keys, "p").agg(
        F.sum(F.col("y").cast("long")).alias("pos"),
        F.sum((1 - F.col("y")).cast("long")).alias("neg"))


def cumulative(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, p, pos, neg, tps, fps, rn, tot_pos, tot_neg) by descending score; rn = 1 for the top score."""
    g = score_groups(pred, keys).withColumn("one", F.lit(1))
    # Keys name models and datasets: their number is bounded by the call.
    c = running_totals(g, keys, "p", ["pos", "neg", "one"], descending=True, totals_prefix="tot_")
    return c.select(*keys, "p", "pos", "neg", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"),
                    F.col("cum_one").alias("rn"), "tot_pos", "tot_neg")


def ranking(pred_groups: DataFrame, keys: list[str], *measures: str) -> DataFrame:
    """auc_roc and / or auc_pr per key from ``cumulative`` rows; products are taken in doubles."""
    d = {c: F.col(c).cast("double") for c in ("pos", "neg", "tps", "fps", "tot_pos", "tot_neg")}
    aggs = {"auc_roc": F.try_divide(F.sum(d["neg"] * (d["tps"] - d["pos"] / 2.0)), F.max(d["tot_pos"]) * F.max(d["tot_neg"])),
            "auc_pr": F.try_divide(F.sum(d["pos"] * d["tps"] / (d["tps"] + d["fps"])), F.max(d["tot_pos"]))}
    return pred_groups.groupBy(*keys).agg(*[aggs[m].alias(m) for m in measures])


def with_next(c: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Attach the next row's ``cols`` (``next_<c>``) along rn: an equi-join on (keys, rn+1)."""
    nxt = c.select(*keys, (F.col("rn") - 1).alias("rn"), *[F.col(x).alias(f"next_{x}") for x in cols])
    return c.join(nxt, keys + ["rn"], "left")


def roc_auc(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area under ROC, ties count one half: sum(neg * (tps - pos/2)) / (P*N)."""
    return ranking(cumulative(pred, keys), keys, "auc_roc")


def average_precision(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Step-wise average precision: sum over thresholds of (pos/P) * tps/(tps+fps)."""
    return ranking(cumulative(pred, keys), keys, "auc_pr").withColumnRenamed("auc_pr", "average_precision")


def brier_score(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_score"))


def roc_curve(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """ROC points with collinear interior points dropped, plus the origin.

    Rows: keys, point (0 = origin), threshold (+inf at the origin), fpr, tpr.
    A point is kept when it is the first or last, or when its (pos, neg)
    step differs from the next one (the slope changes there).
    """
    # two branches (next point, origin) read the cumulative rows: materialise them once
    c = with_next(cut_lineage(cumulative(pred, keys)), keys, ["pos", "neg"])
    keep = (F.col("rn") == 1) | F.col("next_pos").isNull() | \
        (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = c.where(keep).select(*keys, "p", "rn", "tps", "fps", "tot_pos", "tot_neg")
    origin = pts.where(F.col("rn") == 1).select(
        *keys, F.lit(float("inf")).alias("p"), F.lit(0).cast("long").alias("rn"),
        F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"), "tot_pos", "tot_neg")
    allp = pts.unionByName(origin)
    return allp.select(*keys, F.col("p").alias("threshold"),
                       F.try_divide(F.col("fps").cast("double"), F.col("tot_neg").cast("double")).alias("fpr"),
                       F.try_divide(F.col("tps").cast("double"), F.col("tot_pos").cast("double")).alias("tpr"))


def pr_curve(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Precision/recall at every distinct threshold plus the final (1, 0) point (threshold NULL)."""
    c = cut_lineage(cumulative(pred, keys))
    pts = c.select(*keys, F.col("p").alias("threshold"),
                   F.coalesce(F.try_divide(F.col("tps").cast("double"), (F.col("tps") + F.col("fps")).cast("double")),
                              F.lit(0.0)).alias("precision"),
                   F.when(F.col("tot_pos") == 0, F.lit(1.0)).otherwise(
                       F.col("tps").cast("double") / F.col("tot_pos").cast("double")).alias("recall"))
    end = c.where(F.col("rn") == 1).select(*keys, F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def curve_area(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Trapezoid areas of the ROC curve and of the precision-recall curve.

    Rows: keys, curve ('roc' | 'pr'), area.  The PR area differs from average
    precision by construction (linear interpolation between points).
    """
    c = cut_lineage(cumulative(pred, keys))
    # Previous point along descending score: row rn-1, or the curve start for rn = 1.
    prev = c.select(*keys, (F.col("rn") + 1).alias("rn"), F.col("tps").alias("ptps"), F.col("fps").alias("pfps"))
    j = c.join(prev, keys + ["rn"], "left")
    ptps = F.coalesce(F.col("ptps"), F.lit(0)).cast("double")
    pfps = F.coalesce(F.col("pfps"), F.lit(0)).cast("double")
    tps, fps = F.col("tps").cast("double"), F.col("fps").cast("double")
    P, N = F.col("tot_pos").cast("double"), F.col("tot_neg").cast("double")
    # ROC: start at (0, 0).
    roc = F.try_divide((fps - pfps) * (tps + ptps) / 2.0, P * N)
    # PR: start at (recall 0, precision 1); precision at a point is tps/(tps+fps).
    prec = F.coalesce(F.try_divide(tps, tps + fps), F.lit(0.0))
    pprec = F.when(F.col("ptps").isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(ptps, ptps + pfps), F.lit(0.0)))
    pr = F.try_divide((tps - ptps) * (prec + pprec) / 2.0, P)
    agg = j.groupBy(*keys).agg(F.sum(roc).alias("roc"), F.sum(pr).alias("pr"))
    return agg.select(*keys, F.explode(F.array(
        F.struct(F.lit("roc").alias("curve"), F.col("roc").alias("area")),
        F.struct(F.lit("pr").alias("curve"), F.col("pr").alias("area")))).alias("a")
    ).select(*keys, "a.curve", "a.area")


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Inner bin edges of uniform calibration: linspace(0, 1 + 1e-8, n + 1)[1:-1]."""
    return [float(x) for x in np.linspace(0.0, 1.0 + 1e-8, n_bins + 1)[1:-1]]


def calibration(pred: DataFrame, keys: list[str] = KEYS, n_bins: int = 10) -> DataFrame:
    """Uniform-bin reliability table; a score on an edge goes to the lower bin; empty bins absent."""
    b = sum((F.col("p") > F.lit(e)).cast("int") for e in calibration_edges(n_bins))
    return pred.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("prob_true"),
        F.avg("p").alias("prob_pred"))


def histogram_bins(df: DataFrame, group_cols: list[str], value_col: str, n_bins: int) -> DataFrame:
    """Equal-width histogram over each group's own [min, max], last bin closed.

    All ``n_bins`` bins are returned, empty ones with count 0: the bin rows
    come from exploding a sequence per group (no join with a bin table).
    When min == max the range is widened by 0.5 on each side.  Groups are
    columns, models, datasets and classes, so their ranges are few and broadcast:
    the long table meets no exchange but that of its partial counts.
    """
    v = df.where(F.col(value_col).isNotNull())
    rng = v.groupBy(*group_cols).agg(F.min(value_col).alias("_mn"), F.max(value_col).alias("_mx"))
    rng = rng.select(*group_cols,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(n_bins))
    binned = join_on(v, rng, group_cols, small=True).withColumn(
        "bin", F.least(F.floor((F.col(value_col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins),
                       F.lit(n_bins - 1)).cast("int"))
    counts = binned.groupBy(*group_cols, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*group_cols, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    grid = grid.select(*group_cols, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                       (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"))
    return join_on(grid, counts, group_cols + ["bin"], "left").select(
        *group_cols, "bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def score_histogram(pred: DataFrame, keys: list[str] = KEYS, n_bins: int = 50) -> DataFrame:
    """Score distribution per true class, 50 bins over that class's own range."""
    return histogram_bins(pred.withColumnRenamed("y", "label"), keys + ["label"], "p", n_bins)


def with_label(pred: DataFrame, threshold: float = config.DECISION_THRESHOLD) -> DataFrame:
    return pred.withColumn("yhat", (F.col("p") >= F.lit(threshold)).cast("int"))


def confusion_matrix(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    d = with_label(pred)
    y, yh = F.col("y"), F.col("yhat")
    return d.groupBy(*keys).agg(
        F.count_if((y == 0) & (yh == 0)).alias("tn"), F.count_if((y == 0) & (yh == 1)).alias("fp"),
        F.count_if((y == 1) & (yh == 0)).alias("fn"), F.count_if((y == 1) & (yh == 1)).alias("tp"))


def classification_report(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and weighted averages.

    Undefined ratios are 0.0 (the report's default when a denominator is 0).
    """
    cm = confusion_matrix(pred, keys)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1 = ratio(tp, tp + fp), ratio(tp, tp + fn)
    p0, r0 = ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1_1 = ratio(2 * p1 * r1, p1 + r1)
    f1_0 = ratio(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1
    m = cm.select(*keys, p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
                  p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"),
                  ratio(tp + tn, tot).alias("acc"), tot.alias("tot"))

    def row(label, prec, rec, f1, sup):
        return F.struct(F.lit(label).alias("class_label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"))

    c = F.col
    wavg = lambda a, b: ratio(a * c("s0") + b * c("s1"), c("tot"))
    rows = F.array(
        row("0", c("p0"), c("r0"), c("f0"), c("s0")),
        row("1", c("p1"), c("r1"), c("f1"), c("s1")),
        row("accuracy", F.lit(None), F.lit(None), c("acc"), c("tot")),
        row("macro avg", (c("p0") + c("p1")) / 2, (c("r0") + c("r1")) / 2, (c("f0") + c("f1")) / 2, c("tot")),
        row("weighted avg", wavg(c("p0"), c("p1")), wavg(c("r0"), c("r1")), wavg(c("f0"), c("f1")), c("tot")),
    )
    return m.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def model_comparison(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Model x dataset table of AUC-ROC, AUC-PR (average precision) and Brier score."""
    ranked = ranking(cumulative(pred, keys), keys, "auc_roc", "auc_pr")
    return join_on(ranked, brier_score(pred, keys), keys, small=True)


def best_model(comparison: DataFrame, dataset: str = "validation") -> DataFrame:
    """The model with the highest AUC-ROC on ``dataset`` (first model name on ties)."""
    return (comparison.where(F.col("dataset") == dataset)
            .agg(F.min(F.struct((-F.col("auc_roc")).alias("k"), F.col("model").alias("model"),
                                F.col("auc_roc").alias("auc_roc"))).alias("b"))
            .select("b.model", "b.auc_roc"))


def auc_gain(comparison: DataFrame, base: str, other: str) -> DataFrame:
    """Relative AUC-ROC gain of ``other`` over ``base`` per dataset, in percent."""
    w = comparison.groupBy("dataset").agg(
        F.max(F.when(F.col("model") == base, F.col("auc_roc"))).alias("base_auc"),
        F.max(F.when(F.col("model") == other, F.col("auc_roc"))).alias("other_auc"))
    return w.select("dataset", "base_auc", "other_auc",
                    (F.try_divide(F.col("other_auc") - F.col("base_auc"), F.col("base_auc")) * 100.0)
                    .alias("gain_pct"))


def focal_loss(pred: DataFrame, keys: list[str] = KEYS, alpha: float = config.FOCAL_ALPHA,
               gamma: float = config.FOCAL_GAMMA) -> DataFrame:
    """Mean focal loss alpha*(1-pt)^gamma*BCE, BCE clamped at 100; alpha on both classes."""
    q = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    bce = F.when(q <= 0, F.lit(config.BCE_CLAMP)).otherwise(F.least(-F.log(q), F.lit(config.BCE_CLAMP)))
    d = pred.withColumn("_bce", bce)
    fl = F.lit(alpha) * F.pow(1 - F.exp(-F.col("_bce")), F.lit(gamma)) * F.col("_bce")
    return d.groupBy(*keys).agg(F.avg(fl).alias("focal_loss"))
