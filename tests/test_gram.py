"""Correlations by masked block products, against numpy over the rows that both columns have."""

import math
import random

import numpy as np
import pytest

from riskframe.operators import gram, profile


def expected(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    x, y = (np.array(v, float) for v in zip(*both)) if both else (np.empty(0), np.empty(0))
    if len(x) < 2 or x.std() == 0 or y.std() == 0:
        return None
    return float(((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std()))


def table(n, c, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = rng.gauss(0, 1)
        rows.append([None if rng.random() < 0.15 else 1e6 * (k == 1) + base * k + rng.gauss(0, 1) for k in range(c)])
        rows[-1][2] = 7.25                             # constant
        rows[-1][3] = None                             # never there
        rows[-1][4] = float(rng.random() < 0.01)       # rare
    return rows


@pytest.mark.parametrize("n,c,parts", [(500, 12, 5), (2000, 40, 3), (1, 6, 1)])
def test_against_numpy(spark, n, c, parts):
    rows = table(n, c, n)
    names = [f"c {k}" for k in range(c)]
    df = spark.createDataFrame(rows, ", ".join(f"`{x}` double" for x in names)).repartition(parts)
    got = {(r.row_feature, r.col_feature): r.corr for r in profile.correlation_matrix(df, names).collect()}
    assert len(got) == c * c
    for i in range(c):
        for j in range(c):
            want = expected(rows, i, j)
            assert (got[names[i], names[j]] is None) == (want is None)
            assert want is None or abs(got[names[i], names[j]] - want) < 1e-9


def test_rows_are_not_copied_for_pairs(spark):
    df = spark.createDataFrame([tuple(float(i * k % 7) for k in range(30)) for i in range(50)], ", ".join(f"c{k} double" for k in range(30)))
    plan = gram.pair_moments(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_nan_stays_in_its_pairs_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, math.nan), (2.0, 4.0, 1.0), (3.0, 7.0, 2.0)], "a double, b double, c double")
    got = {(r.row_feature, r.col_feature): r.corr for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] > 0.98 and math.isnan(got["a", "c"])
    assert {r.corr for r in profile.correlation_matrix(df.limit(0), ["a", "b"]).collect()} == {None}
