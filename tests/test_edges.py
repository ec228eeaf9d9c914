"""Hand-made edge tables (empty, all NULL, constant, ties, one class)."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import cleaning, counterfactual, features, metrics, profile


def pred(spark, rows):
    return spark.createDataFrame([("m", "d", y, p) for p, y in rows], "model string, dataset string, y int, p double")


def one(df, col):
    return df.collect()[0][col]


def test_median_even_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert cleaning.params_of(cleaning.fit_medians(df, ["x"]))["x"] == 2.5
    assert cleaning.params_of(cleaning.fit_medians(df, ["x"], approx=True))["x"] in (2.0, 3.0)
    filled = cleaning.impute_median(df, ["x"]).collect()
    assert [r.x for r in filled] == [1.0, 2.0, 3.0, 4.0, 2.5]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert cleaning.params_of(cleaning.fit_modes(df, ["c"]))["c"] == "a"
    assert [r.c for r in cleaning.impute_mode(df, ["c"]).collect()][-1] == "a"


def test_all_null_columns_stay_null(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, c string")
    out = cleaning.impute_mode(cleaning.impute_median(df, ["x"]), ["c"]).collect()
    assert all(r.x is None and r.c is None for r in out)


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 4.0)], "id long, x double, y double")
    assert {r.x for r in features.standardize(df, ["x"]).collect()} == {0.0}
    corr = {(r.row_feature, r.col_feature): r.corr for r in profile.correlation_matrix(df, ["x", "y"]).collect()}
    assert corr[("x", "y")] is None and corr[("y", "y")] == pytest.approx(1.0)
    h = profile.histogram_fixed(df, ["x"], 10).where("count > 0").collect()
    assert len(h) == 1 and h[0].bin == 5 and h[0].bin_lo == pytest.approx(5.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, x double, c string")
    assert profile.describe_numeric(df, ["x"]).count() == 0
    assert profile.value_counts(df, ["c"]).count() == 0
    m = profile.missing_profile(df).collect()
    assert all(r.missing_count == 0 and r.missing_percent is None for r in m)


def test_auc_small(spark):
    d = pred(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    assert one(metrics.roc_auc(d), "auc_roc") == pytest.approx(0.75)
    assert one(metrics.average_precision(d), "average_precision") == pytest.approx(0.8333333333)


def test_tied_scores_count_half(spark):
    d = pred(spark, [(0.9, 1), (0.9, 0), (0.5, 1)])
    assert one(metrics.roc_auc(d), "auc_roc") == pytest.approx(0.25)
    assert one(metrics.average_precision(d), "average_precision") == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    areas = {r.curve: r.area for r in metrics.curve_area(d).collect()}
    assert areas["roc"] == pytest.approx(0.25)


def test_one_class_is_undefined(spark):
    d = pred(spark, [(0.2, 0), (0.6, 0), (0.9, 0)])
    assert one(metrics.roc_auc(d), "auc_roc") is None
    assert one(metrics.average_precision(d), "average_precision") is None
    assert one(metrics.brier_score(d), "brier_score") == pytest.approx((0.04 + 0.36 + 0.81) / 3)


def test_edge_scores(spark):
    d = pred(spark, [(0.0, 0), (0.1, 1), (0.5, 0), (0.7, 1), (1.0, 1), (0.5, 1), (0.7, 0)])
    bins = {r.bin: r.n for r in metrics.calibration(d).collect()}
    assert bins == {0: 2, 4: 2, 6: 2, 9: 1}  # edge values fall in the lower bin
    cm = metrics.confusion_matrix(d).collect()[0]
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 2, 1, 3)  # 0.5 counts as positive
    fl = one(metrics.focal_loss(pred(spark, [(0.0, 1), (1.0, 1)])), "focal_loss")
    assert fl == pytest.approx(0.25 * (1 - math.exp(-100)) ** 2 * 100 / 2)
    scored = spark.createDataFrame([(1, 0, 0.7), (2, 1, 0.71)], "id long, status int, predicted_probability double")
    assert [r.test_index for r in counterfactual.high_risk_cases(scored).collect()] == [2]  # strictly above


def test_roc_curve_drops_collinear_points(spark):
    d = pred(spark, [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)])
    pts = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(d).collect())
    # the first threshold is always kept; 0.8 and 0.6 lie on straight segments
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_pr_curve_ends_at_one_zero(spark):
    d = pred(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    rows = metrics.pr_curve(d).collect()
    end = [r for r in rows if r.threshold is None]
    assert len(end) == 1 and end[0].precision == 1.0 and end[0].recall == 0.0
    assert len(rows) == 5


def test_classification_report_zero_division(spark):
    d = pred(spark, [(0.1, 0), (0.2, 0), (0.3, 1)])  # nothing predicted positive
    rep = {r.class_label: r for r in metrics.classification_report(d).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].support == 1
    assert rep["accuracy"].f1_score == pytest.approx(2 / 3)
