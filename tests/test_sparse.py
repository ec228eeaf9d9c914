"""Sparse one-hot vectors: any number of levels, the same model as the dense columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import features, models


def test_hundred_thousand_levels(spark):
    # one level holds a third of the rows
    df = spark.range(0, 150_000).selectExpr("id", "IF(id % 3 = 0, 'L0', CONCAT('L', id % 100000)) AS code", "id % 2 AS x")
    index = features.fit_index(df, ["code"])
    n = df.select("code").distinct().count()
    assert (index.count(), index.agg(F.max("index")).first()[0]) == (n, n - 1)
    enc = features.encode_sparse(df, ["code"], index, ["x"])
    assert enc.columns == ["id", "code", "x", "features"] and enc.count() == 150_000
    place = {r.level: r.position for r in features.vector_positions(index, ["code"], 1).where("level IN ('L0', 'L1', 'L99998')").collect()}
    assert [k for k, _ in sorted(place.items(), key=lambda x: x[1])] == ["L0", "L1", "L99998"]      # byte order
    for r in enc.where("id IN (0, 1, 99998)").collect():
        assert r.features.size == n + 1
        assert r.features.toArray().nonzero()[0].tolist() == [0] * (r.x == 1) + [place[r.code]]


def test_fit_equals_the_dense_fit(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.normal()), f"a{rng.integers(4)}", f"b{rng.integers(6)}", int(rng.random() < 0.4)) for _ in range(600)]
    df = spark.createDataFrame(rows, "z double, a string, b string, status int").cache()
    dense = features.one_hot(df, ["a", "b"])
    want = models.fit_logistic(dense, [c for c in dense.columns if c != "status"], C=1.0)
    index = features.fit_index(df, ["a", "b"])
    got = models.fit_logistic_vectors(features.encode_sparse(df, ["a", "b"], index, ["z"]), C=1.0)
    assert got.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-6)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-6)


def test_unknown_missing_and_clashing(spark):
    fit = spark.createDataFrame([("u", None, 1), ("v", None, 2), ("v", None, 2), (None, None, 2)], "a string, b string, c int")
    index = features.fit_index(fit, ["a", "b", "c"])
    assert features.index_sizes(index, ["a", "b", "c"]) == {"a": 2, "c": 2}
    df = spark.createDataFrame([("v", "x", 1, 0.5, "i"), ("w", None, 9, 1.5, "j"), (None, "u", None, 2.5, "k")],
                               "a string, b string, c int, z double, _index_a string")
    out = features.encode_sparse(df, ["a", "b", "c"], index, ["z"])
    assert out.columns == [*df.columns, "features"]
    assert {r.z: (r["_index_a"], r.features.toArray().tolist()) for r in out.collect()} == {
        0.5: ("i", [0.5, 0, 1, 1, 0]), 1.5: ("j", [1.5, 0, 0, 0, 0]), 2.5: ("k", [2.5, 0, 0, 0, 0])}
    none = features.fit_index(fit.limit(0), ["a"])
    assert [r.features.toArray().tolist() for r in features.encode_sparse(df.select("a", "z"), ["a"], none, ["z"]).orderBy("z").collect()] == [[0.5], [1.5], [2.5]]
    assert features.encode_sparse(df.limit(0), ["a"], index, ["z"]).count() == 0
