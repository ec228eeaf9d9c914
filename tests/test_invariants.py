"""Properties: exactness of the distributed helpers, splits, curves, counterfactuals, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe import config
from riskframe.operators import cleaning, counterfactual, features, metrics, running
from riskframe.operators.running import exact_quantiles, quantiles_wide, running_totals, top_k_per_group
from riskframe.sources import tables


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=500), np.repeat(3.0, 200), rng.integers(0, 5, 300).astype(float)])
    df = spark.createDataFrame([(("g%d" % (i % 3)), float(v)) for i, v in enumerate(vals)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for accuracy in (10000, 50):
        # a coarse sketch makes brackets wide and narrow ones miss nothing
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
        for gi in range(3):
            x = vals[np.arange(len(vals)) % 3 == gi]
            for p in probs:
                assert got[("g%d" % gi, p)] == pytest.approx(np.percentile(x, p * 100), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 20, 101])
def test_quantiles_of_small_groups(spark, n):
    vals = [float((i * 37) % 11) for i in range(n)]
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.prob: r.quantile for r in exact_quantiles(df, [], "v", probs).collect()}
    assert got == pytest.approx({p: np.percentile(vals, p * 100) for p in probs})


def test_quantiles_of_many_rows_use_the_brackets(spark):
    df = spark.range(0, 300_000).selectExpr("CAST((id * 7919) % 300007 AS DOUBLE) AS v", "CAST(id % 2 AS STRING) AS g")
    x = (np.arange(300_000, dtype=np.int64) * 7919 % 300007).astype(float)
    got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9], accuracy=1000).collect()}
    for g in (0, 1):
        for p in (0.25, 0.5, 0.9):
            assert got[str(g), p] == pytest.approx(np.percentile(x[g::2], p * 100))


def test_null_group_is_a_group(spark):
    rows = [("a", 1.0), ("a", 2.0), (None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for small in (True, False):
        out = quantiles_wide(df, ["g"], "v", {"q2": 0.5}, small=small, extra_aggs=[F.count(F.lit(1)).alias("rows")])
        assert {r.g: (r.q2, r.rows) for r in out.collect()} == {"a": (1.5, 2), None: (6.0, 2), "b": (None, 1)}
    t = spark.createDataFrame([(g, i, i + 1) for g in ("a", None) for i in range(400)], "g string, o int, n int")
    want = {(g, i): (i + 1) * (i + 2) // 2 for g in ("a", None) for i in range(400)}
    for buckets in (1, 1024):
        got = running_totals(t, ["g"], "o", ["n"], n_buckets=buckets, totals_prefix="all_").collect()
        assert {(r.g, r.o): r.cum_n for r in got} == want and {r.all_n for r in got} == {80200}


def test_quantiles_wide_extra_aggs(spark):
    # including a group whose values are all NULL
    rows = [("a", float(v)) for v in [4, 1, 3, 2, 2]] + [("b", None), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    extra = [F.count("v").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("v").alias("mx")]
    by_g = {r.g: tuple(r)[1:] for r in quantiles_wide(df, ["g"], "v", {"q1": 0.25, "q2": 0.5}, extra_aggs=extra).collect()}
    assert by_g["a"] == (2.0, 2.0, 5, 5, 4.0)
    assert by_g["b"] == (None, None, 0, 2, None)
    assert [tuple(r) for r in quantiles_wide(df, [], "v", {"q1": 0.25, "q2": 0.5}, extra_aggs=extra).collect()] == [(2.0, 2.5, 6, 8, 7.0)]


def test_running_totals_equal_plain_cumsum(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 2 else "b", float(i), int(rng.integers(0, 10))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o double, n long")
    for desc in (False, True):
        for nb in (1, 5, 64):
            out = {(r.g, r.o): r.cum_n for r in running_totals(df, ["g"], "o", ["n"], descending=desc,
                                                                n_buckets=nb).collect()}
            for g in ("a", "b"):
                sub = sorted((o, n) for gg, o, n in rows if gg == g)
                if desc:
                    sub = sub[::-1]
                acc = 0
                for o, n in sub:
                    acc += n
                    assert out[(g, o)] == acc


def test_results_do_not_depend_on_partitioning(spark, sf_small):
    p = tables.predictions_long(spark, sf_small)
    a = sorted(metrics.roc_auc(p).collect())
    b = sorted(metrics.roc_auc(p.repartition(16)).collect())
    c = sorted(metrics.roc_auc(p.coalesce(1)).collect())
    assert a == b == c


def test_auc_of_reversed_scores(spark, sf_small):
    p = tables.predictions_long(spark, sf_small)
    a = {(r.model, r.dataset): r.auc_roc for r in metrics.roc_auc(p).collect()}
    b = {(r.model, r.dataset): r.auc_roc for r in metrics.roc_auc(p.withColumn("p", 1 - F.col("p"))).collect()}
    for k in a:
        assert a[k] + b[k] == pytest.approx(1.0)


def test_roc_curve_is_monotone(spark, sf_small):
    p = tables.predictions_long(spark, sf_small)
    pts = metrics.roc_curve(p).where("model = 'b' AND dataset = 'train'").orderBy(F.col("threshold").desc()).collect()
    f = [r.fpr for r in pts]
    t = [r.tpr for r in pts]
    assert f == sorted(f) and t == sorted(t) and f[0] == 0.0 and f[-1] == 1.0 and t[-1] == 1.0


def test_splits_are_complete_and_disjoint(spark, sf_small):
    r = cleaning.rename_columns(tables.raw_applications(spark, sf_small)).select("id", "status")
    hs = features.hash_split(r)
    assert hs.count() == r.count() == hs.select("id").distinct().count()
    st = features.stratified_split(r)
    assert st.count() == r.count()
    shares = st.groupBy("status", "dataset").count().collect()
    for cls in (0, 1):
        tot = sum(x["count"] for x in shares if x.status == cls)
        train = sum(x["count"] for x in shares if x.status == cls and x.dataset == "train")
        assert abs(train / tot - 0.8) < 0.01


def test_cleaning_leaves_no_missing_values(spark, sf_small):
    c = cleaning.clean_data(tables.raw_applications(spark, sf_small), categoricals=config.FIXTURE_CATEGORICALS)
    assert c.select([F.count_if(F.col(x).isNull()).alias(x) for x in c.columns]).collect()[0].asDict() == \
        {x: 0 for x in c.columns}


def test_counterfactuals_flip_and_change_only_mutable(spark, sf_small):
    raw = tables.raw_applications(spark, sf_small)
    prep = features.fit_prep(raw)
    p = prep.transform(raw)
    from riskframe.operators import models
    s = models.score_linear(p, keep=["id", "dataset", "status"])
    cases = counterfactual.high_risk_cases(s, n_cases=None)
    feats = p.join(cases.select(F.col("test_index").alias("id")), "id", "left_semi")
    ranges = counterfactual.fetch_ranges(counterfactual.feature_ranges(p.where("dataset = 'train'")))
    cfs = counterfactual.generate(feats, ranges)
    rows = cfs.collect()
    assert rows and all(r.predicted_proba < 0.5 for r in rows)
    assert max(r.cf_no for r in rows) <= config.TOTAL_CFS
    d = counterfactual.deltas(feats, cfs)
    per = {(r.case_id, r.cf_no): r["count"] for r in d.groupBy("case_id", "cf_no").count().collect()}
    assert all(per[(r.case_id, r.cf_no)] == r.n_changed for r in rows)
    assert set(r.feature for r in d.collect()) <= set(config.MUTABLE_FEATURES)


def test_top_k_two_rounds_equals_plain_sort(spark):
    rows = [("g%d" % (i % 2), "v%03d" % i, (i * 37) % 11) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v string, n long")
    got = top_k_per_group(df, ["g"], [F.col("n").desc(), F.col("v").asc()], 7, "v", salt_buckets=5)
    got = sorted((r.g, r.rank, r.v) for r in got.collect())
    want = []
    for g in ("g0", "g1"):
        sub = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))[:7]
        want += [(g, i + 1, x[1]) for i, x in enumerate(sub)]
    assert got == sorted(want)


def _brute_knn(pts, k):
    import math as _m
    out = {}
    for i, (a, xa) in enumerate(pts):
        d = sorted((_m.sqrt(sum((p - q) ** 2 for p, q in zip(xa, xb))), b) for b, xb in pts if b != a)
        out[a] = [b for _, b in d[:k]]
    return out


def test_grid_knn_is_exact(spark):
    from riskframe.operators import neighbors
    rng = np.random.default_rng(11)
    xs = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(0, 0.01, (60, 2)) + 3.0, [[40.0, -40.0]]])
    xs = np.round(xs, 3)
    pts = [(i + 1, tuple(float(v) for v in x)) for i, x in enumerate(xs)]
    df = spark.createDataFrame([(i, x[0], x[1]) for i, x in pts], "id long, a double, b double")
    want = _brute_knn(pts, 4)
    for max_cell in (10, 20000):  # a tiny limit forces refinement of the dense spot
        got = {}
        for r in neighbors.knn(df, ["a", "b"], 4, max_cell=max_cell).collect():
            got.setdefault(r.id, []).append((r.rank, r.neighbor_id))
        got = {i: [n for _, n in sorted(v)] for i, v in got.items()}
        assert got == want  # including the far outlier, resolved in a later round


def test_smote_balances_exactly(spark):
    from riskframe.operators import neighbors
    rng = np.random.default_rng(5)
    xs = rng.normal(size=(37, 2))
    df = spark.createDataFrame([(i + 1, float(x[0]), float(x[1])) for i, x in enumerate(xs)], "id long, a double, b double")
    syn = neighbors.smote(df, ["a", "b"], n_majority=100, k=3)
    rows = syn.collect()
    assert len(rows) == 100 - 37
    per_base = {}
    for r in rows:
        per_base[r.base_id] = per_base.get(r.base_id, 0) + 1
        assert 0.0 <= r.step < 1.0
    assert set(per_base.values()) <= {1, 2}  # q = 1, remainder spread one each
    nb = {(r.id, r.neighbor_id) for r in neighbors.knn(df, ["a", "b"], 3).collect()}
    assert all((r.base_id, r.neighbor_id) in nb for r in rows)


def test_permitted_ranges_bound_generated_values(spark, sf_small):
    from riskframe.operators import models
    raw = tables.raw_applications(spark, sf_small)
    p = features.fit_prep(raw).transform(raw)
    ranges = counterfactual.feature_ranges(p.where("dataset = 'train'"))
    bounds = counterfactual.fetch_ranges(ranges, {"loan_amount": (-0.5, 0.5), "income": (None, 0.0)})
    assert bounds["loan_amount"] == (-0.5, 0.5) and bounds["income"][1] == 0.0
    s = models.score_linear(p, keep=["id", "dataset", "status"])
    cases = counterfactual.high_risk_cases(s, n_cases=None)
    feats = p.join(cases.select(F.col("test_index").alias("id")), "id", "left_semi")
    d = counterfactual.deltas(feats, counterfactual.generate(feats, bounds)).collect()
    assert all(-0.5 <= r.counterfactual <= 0.5 for r in d if r.feature == "loan_amount")
    assert all(r.counterfactual <= 0.0 for r in d if r.feature == "income")
    with pytest.raises(ValueError):
        counterfactual.fetch_ranges(ranges, {"ltv": (1e9, None)})


def test_quantile_ranks_outside_their_brackets_are_read_again(spark, monkeypatch):
    df = spark.createDataFrame([(g, float(v), None) for g in ("a", None) for v in range(1000)], "g string, v double, w string")
    honest = running._bracketed

    def off(*args):
        # brackets far from every rank: the first two and the last value of each group
        found = honest(*args)
        n = len(running._bracket_ends(args[3], args[4])[0])
        return found.withColumn("_ends", F.array(*[F.lit(float(min(i, 1) if i < n - 1 else 999)) for i in range(n)]))

    monkeypatch.setattr(running, "_bracketed", off)
    probs = [0.0, 0.2505, 0.5, 0.77, 1.0]
    for small in (True, False):
        got = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, ["g"], "v", probs, small=small).collect()}
        assert got == pytest.approx({(g, p): np.percentile(np.arange(1000.0), 100 * p) for g in ("a", None) for p in probs})


def test_quantile_windows_stay_bounded(spark, monkeypatch):
    # one group of 400,000 rows and wide brackets: more cells than a window may hold
    monkeypatch.setattr(running, "WINDOW_ROWS", 2_000)
    totals, buckets = running.running_totals, []

    def counted(cells, *args, **kw):
        buckets.append((cells.count(), kw["n_buckets"]))
        return totals(cells, *args, **kw)

    monkeypatch.setattr(running, "running_totals", counted)
    df = spark.range(400_000).selectExpr("CAST((id * 7919) % 400009 AS DOUBLE) AS v")
    x = (np.arange(400_000, dtype=np.int64) * 7919 % 400009).astype(float)
    got = {r.prob: r.quantile for r in exact_quantiles(df, [], "v", [0.25, 0.5, 0.9], accuracy=500).collect()}
    assert got == pytest.approx({p: np.percentile(x, 100 * p) for p in (0.25, 0.5, 0.9)})
    assert buckets[0][0] > 10_000 and buckets[0][0] <= 2_000 * buckets[0][1]
