"""Counterfactuals with unneeded changes undone."""

import math
import random

from pyspark.sql import functions as F

from riskframe import config
from riskframe.operators import counterfactual as cf

MUT = config.MUTABLE_FEATURES
W, B = config.SCORE_COEFFICIENTS, config.SCORE_INTERCEPT
RANGES = {f: (-3.0, 3.0) for f in MUT}


def proba(x):
    return 1 / (1 + math.exp(-(B + sum(W[f] * x[f] for f in W))))


def cases(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        x = {f: rng.uniform(-3, 3) for f in MUT}
        if proba(x) > 0.7:
            rows.append((len(rows), *[x[f] for f in MUT]))
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in MUT))


def test_no_changed_value_can_go_further_back(spark):
    c = cases(spark)
    found = cf.generate(c, RANGES)
    was = {(r.case_id, r.cf_no): r.asDict() for r in found.collect()}
    now = {(r.case_id, r.cf_no): r.asDict() for r in cf.sparsify(c, found, RANGES).collect()}
    own = {r.id: r.asDict() for r in c.collect()}
    assert was.keys() == now.keys() and len(now) > 60
    fewer = 0
    for key, x in now.items():
        o, before = own[key[0]], was[key]
        assert proba(x) < 0.5 and abs(proba(x) - x["predicted_proba"]) < 1e-12
        changed = [f for f in MUT if x[f] != o[f]]
        assert changed and set(changed) <= {f for f in MUT if before[f] != o[f]} and x["n_changed"] == len(changed)
        assert x["distance"] <= before["distance"] + 1e-9
        fewer += len(changed) < before["n_changed"]
        for f in changed:
            assert min(o[f], before[f]) <= x[f] <= max(o[f], before[f])
            nudge = (o[f] - x[f]) * 1e-6 + math.copysign(1e-8, o[f] - x[f])
            assert proba(x | {f: x[f] + nudge}) >= 0.5
    assert fewer > 5


def test_order_decides_which_change_goes(spark):
    c = spark.createDataFrame([(1, *[0.0] * 7)], "id long, " + ", ".join(f"{f} double" for f in MUT))
    cfs = spark.createDataFrame([(1, 1, 0, 2, 0.5, 0.1, *[3.0 if f == "income" else -3.0 if f == "ltv" else 0.0 for f in MUT])],
                                "case_id long, cf_no int, candidate int, n_changed int, distance double, predicted_proba double, " + ", ".join(f"{f} double" for f in MUT))
    for keep, order in (("ltv", ["income", "ltv"]), ("income", ["ltv", "income"])):
        score = cf.linear_probability(W, 0.9)
        row = cf.sparsify(c, cfs, RANGES, order=order, score=score).first()
        assert row.n_changed == 1 and row[keep] != 0.0
    kept = cf.sparsify(c.withColumn("income", F.lit(None).cast("double")), cfs, RANGES, order=["income"]).first()
    assert kept.income == 3.0


def test_empty(spark):
    c = cases(spark, 2)
    assert cf.sparsify(c, cf.generate(c, RANGES).limit(0), RANGES).collect() == []


def test_only_the_best_of_a_batch_leave_it(spark):
    c = cases(spark, 300, 5).repartition(2).localCheckpoint()
    found = cf.generate(c, RANGES)
    plan = found._jdf.queryExecution().executedPlan().toString()      # printed from the last step to the first
    assert "Exchange " in plan and max(plan.rindex("Sort "), plan.rindex("Exchange ")) < plan.index("MapInArrow")
    want = {(r.case_id, r.cf_no): r.candidate for r in found.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")               # a case's candidates in many batches
    try:
        assert {(r.case_id, r.cf_no): r.candidate for r in cf.generate(c, RANGES).collect()} == want and len(want) > 500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_candidates_without_a_score_take_no_place(spark):
    c = cases(spark, 30).withColumn("term", F.lit(None).cast("double"))
    found = cf.generate(c, RANGES).collect()
    assert len({r.case_id for r in found}) > 20 and all(r.term is not None and r.predicted_proba < 0.5 for r in found)
    assert all(sorted(r.cf_no for r in found if r.case_id == i) == list(range(1, 1 + sum(r.case_id == i for r in found))) for i in {r.case_id for r in found})
