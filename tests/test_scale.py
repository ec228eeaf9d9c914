"""Rules for large tables: no caps, no lost rows, no overflow, tiny sides broadcast, honest model checks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe import config
from riskframe.functions.hashing import unit_hash, unit_hash_sql
from riskframe.operators import cleaning, counterfactual, features, metrics, models, neighbors, profile
from riskframe.operators.running import running_totals
from riskframe.sources import io, tables
from riskframe.streaming import scoring


# ------------------------------------------------------------------- keyed hash

def test_hash_of_large_and_composite_keys_matches_sql(spark):
    import duckdb
    keys = [0, 1, 42_000_000, 8_500_000_000, 1 << 62, -5]
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, j long")
    got = df.select("k", unit_hash("k", 7).alias("u"), unit_hash(["k", "j"], 8).alias("v")).collect()
    con = duckdb.connect()
    for r in got:
        want = con.execute(f"SELECT {unit_hash_sql(str(r.k), 7)}, {unit_hash_sql([str(r.k), str(r.k % 7)], 8)}").fetchone()
        assert (r.u, r.v) == want and 0 <= r.u < 1
    assert df.select(unit_hash(F.lit(None).cast("long"), 1).alias("u")).first().u is None


def test_draws_of_different_salts_are_independent(spark):
    salts = [4, 5, 7, 8, 9, 21]
    df = spark.range(1, 5001).select(*[unit_hash("id", s).alias(f"u{s}") for s in salts])
    x = np.array([tuple(r) for r in df.collect()])
    c = np.corrcoef(x.T)
    assert np.abs(c - np.eye(len(salts))).max() < 0.06
    # no fixed relation among three salts, whole-number multiples included
    for a in range(-3, 4):
        for b in range(-3, 4):
            if a or b:
                rest = (x[:, 4] + a * x[:, 2] + b * x[:, 3]) % 1
                assert abs(rest.mean() - 0.5) < 0.03 and rest.std() > 0.25


# ------------------------------------------------------------- whole results

def test_stratified_split_keeps_null_labels_and_repeated_rows(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(50)] + [(1, 1)]
    df = spark.createDataFrame(rows, "id long, status int")
    out = features.stratified_split(df).collect()
    assert len(out) == 51 and sum(r.status is None for r in out) == 10
    assert {r.dataset for r in out if r.status is None} >= {"train", "test"}


def test_stream_reads_a_table_of_part_files(spark, sf_small, tmp_path):
    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    orders.repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(f"{sf_small}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    prep = features.fit_prep(tables.raw_applications(spark, sf_small))
    seen = []
    q = (scoring.application_stream(spark, str(tmp_path)).writeStream
         .foreachBatch(lambda df, epoch: seen.append(df.count()))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(seen) == orders.count() and len([n for n in seen if n]) == 4
    got = scoring.score_stream(spark, str(tmp_path), prep)
    assert got.count() == scoring.score_stream(spark, sf_small, prep).count() == orders.count()


def test_knn_with_many_duplicates(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([np.zeros((300, 2)), np.round(rng.normal(5, 1, (60, 2)), 1), [[5.0, 5.0]] * 20])
    df = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(xs)], "id long, a double, b double")
    got = {}
    for r in neighbors.knn(df, ["a", "b"], 3, max_cell=20).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbor_id, r.distance))
    assert len(got) == len(xs)
    for i, (a, b) in enumerate(xs):
        d = sorted((math.hypot(a - p, b - q), j + 1) for j, (p, q) in enumerate(xs) if j != i)[:3]
        assert [(n, round(x, 9)) for _, n, x in sorted(got[i + 1])] == [(j, round(x, 9)) for x, j in d]


def test_one_hot_limit_is_an_argument(spark):
    df = spark.createDataFrame([(str(i),) for i in range(30)], "c string")
    assert len(features.one_hot(df, ["c"]).columns) == 30
    with pytest.raises(ValueError):
        features.one_hot(df, ["c"], max_levels=10)


# --------------------------------------------------------------------- metrics

def test_ranking_of_very_large_counts(spark):
    half = 45_000_000_000
    g = spark.createDataFrame([("m", 0.9, half, 0, half, 0), ("m", 0.1, 0, 105_000_000_000, half, 105_000_000_000)],
                              "model string, p double, pos long, neg long, tps long, fps long")
    g = g.withColumns({"tot_pos": F.lit(half), "tot_neg": F.lit(105_000_000_000)})
    r = metrics.ranking(g, ["model"], "auc_roc", "auc_pr").first()
    assert r.auc_roc == pytest.approx(1.0) and r.auc_pr == pytest.approx(1.0)


def test_thresholds_equal_at_six_places_stay_apart(spark):
    from riskframe.plans.common import rounded
    df = spark.createDataFrame([("m", "d", i % 2, 0.5 + i * 1e-9) for i in range(6)], "model string, dataset string, y int, p double")
    c = rounded(metrics.pr_curve(df), ["precision", "recall"])
    assert len({r.threshold for r in c.collect() if r.threshold is not None}) == 6


# ----------------------------------------------------------------------- plans

def test_tiny_sides_are_broadcast(spark, sf_small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = tables.raw_applications(spark, sf_small)
        plans = [profile.histogram_fixed(raw, ["loan_amount", "income"]), profile.density(raw, ["loan_amount"]),
                 profile.box_stats(raw, ["loan_amount"]), profile.grid_density(raw, [("loan_amount", "income")], "Status"),
                 metrics.score_histogram(tables.predictions_long(spark, sf_small))]
        for df in plans:
            df.collect()
            text = df._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in text.splitlines() if "SortMergeJoin" in x and ("feature" in x or "pair" in x or "model" in x) and "bin" not in x]
            assert not joins, joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_bucket_lookup_grows_slowly(spark):
    import time
    df = spark.range(0, 100_000).selectExpr("id AS o", "CAST(1 AS LONG) AS n")
    took = {}
    for n in (16, 1024, 16, 1024):
        t = time.time()
        assert running_totals(df, [], "o", ["n"], n_buckets=n).agg(F.max("cum_n")).first()[0] == 100_000
        took[n] = time.time() - t
    assert took[1024] < 3 * took[16] + 2


def test_checkpoint_folder_is_never_made_up_on_a_cluster():
    from riskframe.session import checkpoint_dir

    class None_:
        def isDefined(self):
            return False

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://head:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        def getCheckpointDir(self):
                            return None_()
                    return S()
    with pytest.raises(RuntimeError):
        checkpoint_dir(Fake)


# ---------------------------------------------------------------------- models

@pytest.fixture(scope="module")
def encoded(spark, sf_small):
    from riskframe.plans.q_models import model_input
    return model_input(spark, sf_small)


def newton(x, y, c, steps=50):
    n = len(y)
    x = np.hstack([x, np.ones((n, 1))])
    pen = np.diag([1 / (c * n)] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x / n + pen
        w -= np.linalg.lstsq(h, x.T @ (p - y) / n + pen @ w, rcond=None)[0]
    return w


def test_logistic_fit_against_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, status int")
    for c in (0.1, 100.0):
        m = models.fit_logistic(df, ["a", "b", "c"], C=c)
        assert [*m.coefficients, m.intercept] == pytest.approx(newton(x, y, c), abs=1e-4)
        assert all(abs(r.gradient) < 1e-6 for r in models.logistic_gradient(df, m, ["a", "b", "c"], c).collect())
    with pytest.raises(ValueError):
        models.coefficient_table(spark, m, ["a", "b"])


def test_mlp_is_no_worse_than_the_logistic_model(spark, encoded):
    enc, names = encoded
    train, val = enc.where("dataset = 'train'"), enc.where("dataset = 'validation'")
    mlp = models.fit_mlp(train, val, names)
    keep = ["id", "dataset", "status"]
    auc = {}
    for name, m in (("mlp", mlp), ("logistic", models.fit_logistic(train, names))):
        recs = models.as_prediction_records(models.score_model(m, val, names, keep), name)
        auc[name] = metrics.roc_auc(recs).first().auc_roc
    assert auc["mlp"] >= auc["logistic"] - 0.01


def test_network_blocks_hold_two_layers_in_one_skip(spark, tmp_path):
    net = models.rule_network(3, (4, 2))
    models.save_network(spark, net, str(tmp_path / "net"))
    assert models.load_network(spark, str(tmp_path / "net")) == json.loads(json.dumps(net))
    x = np.array([[0.5, -1.0, 2.0], [0.0, 0.0, 0.0]])
    h = x

    def aff(h, l):
        return (h @ np.array(l["w"]) + l["b"]) * np.array(l.get("scale", 1.0)) + np.array(l.get("shift", 0.0))
    for part in net[:-1]:
        if "dense" in part:
            h = np.maximum(aff(h, part["dense"]), 0)
        else:
            a, b = part["block"]
            h = np.maximum(h + aff(np.maximum(aff(h, a), 0), b), 0)
    want = 1 / (1 + np.exp(-aff(h, net[-1]["output"])))
    assert models.network_forward(x, net) == pytest.approx(want.reshape(-1))


def test_counterfactuals_of_any_scorer_are_whole_rows(spark, sf_small):
    raw = tables.raw_applications(spark, sf_small)
    p = features.fit_prep(raw).transform(raw)
    net = models.rule_network(len(config.SCALED_COLS))
    ranges = counterfactual.fetch_ranges(counterfactual.feature_ranges(p.where("dataset = 'train'")))

    def scorer(df):
        out = models.score_network(df, config.SCALED_COLS, net, df.columns)
        return out.drop("predicted_label").withColumnRenamed("predicted_probability", "predicted_proba")
    scored = models.score_network(p, config.SCALED_COLS, net, p.columns)
    cases = counterfactual.top_cases(scored, 5, threshold=0.5).select("id", *config.SCALED_COLS, *config.FIXTURE_CATEGORICALS)
    carry = ["year", *config.FIXTURE_CATEGORICALS]
    rows = counterfactual.generate(cases, ranges, scorer=scorer, carry=carry).collect()
    own = {r.id: r for r in cases.collect()}
    assert rows and all(r.label == 0 and r.predicted_proba < 0.5 for r in rows)
    for r in rows:
        assert all(r[c] == own[r.case_id][c] for c in carry)
        x = np.array([[r[c] for c in config.SCALED_COLS]])
        assert models.network_forward(x, net)[0] == pytest.approx(r.predicted_proba)


# -------------------------------------------------------------- the CSV step

def test_cleaning_of_the_full_column_list_from_csv_to_csv(spark, tmp_path):
    raw_name = {v: k for k, v in config.RENAME_MAP.items()}
    cats = [raw_name.get(c, c) for c in config.CATEGORICAL_COLS]
    nums = [raw_name.get(c, c) for c in config.NUMERIC_COLS]
    drops = [raw_name.get(c, c) for c in config.DROP_COLS]
    cols = ["ID", "year", "Status", *nums, *drops, *cats]
    assert len(cols) == 34 and len(cats) == 21
    rows = []
    for i in range(12):
        rows.append((i, 2019, i % 2, *[None if (i + j) % 5 == 0 else float(10 + i * (j + 1)) for j in range(len(nums))],
                     *[1.0] * len(drops), *[None if (i + j) % 6 == 0 else f"v{(i * j) % 3}" for j in range(len(cats))]))
    schema = ", ".join(f"`{c}` {'int' if c in ('ID', 'year', 'Status') else 'double' if c in nums + drops else 'string'}" for c in cols)
    io.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "raw"))
    raw = io.read_csv(spark, str(tmp_path / "raw"), schema)
    out = cleaning.clean_data(raw)
    io.write_csv(out, str(tmp_path / "clean"))
    back = io.read_csv(spark, str(tmp_path / "clean"))
    assert len(back.columns) == 31 and back.count() == 12
    assert set(back.columns) == {"id", "year", "status", *config.NUMERIC_COLS, *config.CATEGORICAL_COLS}
    assert all(v is not None for r in back.collect() for v in r)
    col = [r[3 + nums.index("income")] for r in rows]
    med = float(np.median([v for v in col if v is not None]))
    got = {r.id: r.income for r in back.collect()}
    assert got == pytest.approx({i: math.log1p(med if v is None else v) for i, v in enumerate(col)})
    with pytest.raises(KeyError):
        cleaning.clean_data(raw.drop("Region"))


def test_missing_name_list_is_reported_by_the_reader(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_feature_names(spark, str(tmp_path / "none.txt"))


def test_prefix_scan_joins_on_partition_numbers_alone(spark):
    # a class with most rows, one value's classes that no boundary cuts, a NULL class; same rows on 1 and 1,024 partitions
    t = spark.range(30_000).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN NULL ELSE CONCAT('g', id % 700) END AS g",
                                       "id AS o", "id % 5 AS n")
    found = {}
    for n in (1, 7, 1024):
        scan = running_totals(t, ["g"], "o", ["n"], n_buckets=n, totals_prefix="all_")
        found[n] = sorted(map(tuple, scan.collect()), key=str)
        plan = scan._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) == (n > 1) and all("_part" in line and "g#" not in line for line in joins)
    assert found[1] == found[7] == found[1024] and len(found[1]) == 30_000


def test_one_file_is_dealt_over_the_cores(spark, sf_small):
    from riskframe.sources import tables
    cores = spark.sparkContext.defaultParallelism
    raw = tables.raw_applications(spark, sf_small)
    held = [n for n in raw.select("ID").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(held) >= cores and max(held) < 3 * sum(held) / len(held)
    wide = spark.range(100, numPartitions=3 * cores)
    assert tables.spread(wide, "id").rdd.getNumPartitions() == 3 * cores


def test_a_micro_batch_of_one_file_is_dealt_over_the_cores(spark, sf_small):
    from riskframe.streaming import scoring
    plan = scoring.application_stream(spark, sf_small)._jdf.queryExecution().analyzed().toString()
    assert f"RepartitionByExpression [o_orderkey" in plan
