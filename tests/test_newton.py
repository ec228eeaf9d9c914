"""Many regressions in one batch, against separate fits."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskframe.operators import models, newton

NAMES = ["a", "b x", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(900):
        x = [rng.gauss(0, 1), rng.gauss(1, 2), float(rng.random() < 0.3), rng.gauss(0, 0.1)]
        p = 1 / (1 + np.exp(-(0.8 * x[0] - 0.5 * x[1] + 1.2 * x[2] - 0.3)))
        out.append((*x, int(rng.random() < p), i % 3))
    return spark.createDataFrame(out, "a double, `b x` double, c double, d double, status int, fold int").repartition(4).cache()


def test_equals_separate_fits(rows):
    grid = newton.cv_grid(rows, NAMES, (0.01, 100.0), folds=3)
    assert len(grid.fits) == 8 and grid.rounds <= 12
    ev = BinaryClassificationEvaluator(labelCol="status", numBins=0)
    own = {(r["fold"], r["C"]): r["auc_roc"] for r in newton_aucs(grid)}
    data = models.assemble(rows, NAMES).withColumn("status", F.col("status").cast("double"))
    seen = {0.01: [], 100.0: []}
    for p in grid.fits:
        part = data if p.left_out is None else data.where(F.col("fold") != p.left_out)
        lr = LogisticRegression(featuresCol="features", labelCol="status", regParam=1 / (p.C * part.count()), elasticNetParam=0.0, standardization=False,
                                maxIter=1000, tol=1e-14).fit(part)
        assert p.rows == part.count()
        assert np.abs(np.array(lr.coefficients) - p.coefficients).max() < 1e-6 and abs(lr.intercept - p.intercept) < 1e-6
        if p.left_out is not None:
            auc = ev.evaluate(lr.transform(data.where(F.col("fold") == p.left_out)))
            seen[p.C].append(auc)
            assert own[p.left_out, p.C] == pytest.approx(auc, abs=1e-6)
    assert grid.means == pytest.approx({c: np.mean(v) for c, v in seen.items()}, abs=1e-6)
    assert grid.best.C == max(seen, key=lambda c: np.mean(seen[c])) and grid.best.left_out is None


def newton_aucs(grid):
    from riskframe.operators.metrics import roc_auc
    return roc_auc(grid.scores, ["fold", "C"]).collect()


def test_jobs_follow_the_rounds_not_the_fits(spark, rows):
    data = rows.select("*", F.col("status").alias("y"))
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for name, problems in (("one", [newton.Problem(None, 1.0)]), ("many", [newton.Problem(f, c) for f in range(3) for c in (0.1, 1.0, 10.0, 100.0)])):
        spark.sparkContext.setJobGroup(name, name)
        try:
            fits, rounds = newton.fit_all(data, NAMES, problems)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[name] = len(tracker.getJobIdsForGroup(name)) / rounds
    assert jobs["one"] == jobs["many"]
    slopes = newton.largest_slopes(data, NAMES, fits).collect()
    assert len(slopes) == 12 and max(r.slope for r in slopes) < 1e-8 and {r.n for r in slopes} == {600}


def test_separable_dependent_and_empty(spark):
    rows = spark.createDataFrame([(float(i), 1.0 - (i > 4), float(i > 4), int(i > 4), i % 2) for i in range(10)], "x double, u double, v double, y int, fold int")
    fits, _ = newton.fit_all(rows, ["x", "u", "v"], [newton.Problem(None, 100.0), newton.Problem(0, 1.0)])
    assert all(np.isfinite(p.weights).all() for p in fits) and [p.rows for p in fits] == [10, 5]
    none, _ = newton.fit_all(rows.limit(0), ["x"], [newton.Problem(None, 1.0)])
    assert none[0].rows == 0 and not none[0].weights.any()


def test_slopes_copy_no_row_a_problem(spark, rows):
    data = rows.select("*", F.col("status").alias("y"))
    problems = [newton.Problem(f, c, np.array([0.5, -0.2, 0.1, 0.3, -0.4])) for f in (None, 0, 9) for c in (0.1, 10.0)]
    found = newton.largest_slopes(data, NAMES, problems)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    local = data.toPandas()
    x, y = np.column_stack([local[NAMES].to_numpy(float), np.ones(len(local))]), local["y"].to_numpy()
    got = {r.problem: r for r in found.collect()}
    for i, p in enumerate(problems):
        used = np.ones(len(y), bool) if p.left_out is None else (local["fold"] != p.left_out).to_numpy()
        g = ((1 / (1 + np.exp(-(x @ p.weights))) - y)[used, None] * x[used]).mean(0)
        g[:-1] += p.coefficients / (p.C * used.sum())
        assert got[i].slope == pytest.approx(np.abs(g).max(), abs=1e-12) and got[i].n == used.sum() and got[i].left_out == p.left_out
    assert newton.largest_slopes(data.limit(0), NAMES, problems).collect() == []


def test_scores_of_a_fold_and_c_are_read_alone(rows):
    grid = newton.cv_grid(rows, NAMES, (0.01, 100.0), folds=3)
    whole, one = grid.scores.inputFiles(), grid.scores.where((F.col("fold") == 1) & (F.col("C") == 0.01))
    assert sorted(grid.aucs) == sorted((r["fold"], r["C"], r["auc_roc"]) for r in newton_aucs(grid))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and len(whole) >= 6
