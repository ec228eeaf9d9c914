"""Orders that arrive before their customer."""

import os
import time

import pytest

from riskframe.operators import features
from riskframe.plans import common
from riskframe.streaming import late


@pytest.fixture()
def folder(tmp_path):
    for name in ("orders", "customer"):
        os.makedirs(tmp_path / "in" / f"{name}.parquet")
    return str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "ck"))


def add(df, path, name):
    """One more part file of a growing table."""
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}.parquet")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_customer_comes_a_batch_later(spark, sf_small, folder):
    path, folders = folder
    prep = features.fit_prep(common.raw(spark, sf_small))
    orders, customers = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("orders", "customer"))
    first = orders.where("o_custkey % 5 = 0 and o_orderkey % 3 = 0")
    keys = sorted({r.o_custkey for r in first.select("o_custkey").collect()})
    known, later, never = keys[::3], keys[1::3], keys[2::3]
    of = lambda part, some=first: sorted(r.o_orderkey for r in some.where(some.o_custkey.isin(part)).collect())
    add(customers.where(customers.c_custkey.isin(known)), path, "customer")
    add(first, path, "orders")
    run = lambda patience: late.late_scores(spark, path, prep, patience, 100, folders)

    scores, dead = run(3600.0)
    assert ids(scores) == of(known) and dead.count() == 0

    add(customers.where(customers.c_custkey.isin(later)), path, "customer")
    scores, dead = run(3600.0)
    assert ids(scores) == sorted(of(known) + of(later)) and dead.count() == 0          # once each

    second = orders.where("o_orderkey % 3 = 1").where(orders.o_custkey.isin(later[:2]))
    add(second, path, "orders")                                                     # the customer is remembered
    scores, dead = run(3600.0)
    want = sorted(of(known) + of(later) + of(later[:2], second))
    assert ids(scores) == want and dead.count() == 0 and len(of(later[:2], second)) > 0

    whole = {r.id: r.predicted_probability for r in late.models.score_linear(prep.transform(common.raw(spark, sf_small))).collect()}
    assert all(r.predicted_probability == pytest.approx(whole[r.id], abs=1e-12) for r in scores.collect())


def test_expired_orders_are_kept_apart(spark, sf_small, folder):
    path, folders = folder
    prep = features.fit_prep(common.raw(spark, sf_small))
    orders, customers = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("orders", "customer"))
    key = orders.first().o_custkey
    mine = orders.where(orders.o_custkey == key)
    add(mine, path, "orders")
    add(customers.limit(0), path, "customer")
    scores, dead = late.late_scores(spark, path, prep, 0.5, 100, folders)
    time.sleep(1.0)
    for _ in range(2):                                       # newer data lets the timer fire
        add(customers.where(customers.c_custkey != key).limit(3), path, "customer")
        scores, dead = late.late_scores(spark, path, prep, 0.5, 100, folders)
    assert scores.count() == 0
    assert sorted(map(str, dead.select("o_orderkey", "o_totalprice", "o_orderdate").collect())) == sorted(map(str, mine.select("o_orderkey", "o_totalprice", "o_orderdate").collect()))
    add(customers.where(customers.c_custkey == key), path, "customer")
    scores, dead = late.late_scores(spark, path, prep, 0.5, 100, folders)
    assert scores.count() == 0 and dead.count() == mine.count()      # not scored after all


class State:
    """A group's state without a stream."""
    def __init__(self):
        self.kept, self.timer, self.hasTimedOut, self.now = None, None, False, 0
    exists = property(lambda self: self.kept is not None)
    get = property(lambda self: self.kept)
    getCurrentWatermarkMs = lambda self: self.now

    def update(self, value):
        self.kept = value

    def remove(self):
        self.kept = None

    def setTimeoutTimestamp(self, at):
        self.timer = at


def test_many_keys_share_a_state():
    import pandas as pd
    state, step = State(), late._meet(1000)
    frame = lambda rows: pd.DataFrame([(k, kind, row, pd.Timestamp(at, unit="ms")) for k, kind, row, at in rows], columns=["key", "kind", "row", "arrived"])
    met = lambda *frames: [tuple(r) for out in step((0, 0), iter([frame(f) for f in frames]), state) for r in out.itertuples(index=False)]
    assert met([("1", "order", "o1", 100), ("2", "order", "o2", 100), (None, "order", "o0", 100)]) == [] and state.timer == 1100
    assert met([("2", "customer", "c2", 200), (None, "customer", "c0", 200)]) == [("o2", "c2", False)]
    assert met([("2", "order", "o3", 300), ("2", "customer", "c2a", 300)], [("2", "customer", "c2b", 300), ("3", "order", "o4", 300)]) == [("o3", "c2b", False)]
    kept = state.kept
    assert met([("2", "order", "o5", 400)]) == [("o5", "c2b", False)]
    state.hasTimedOut, state.now = True, 1200
    assert met([]) == [("o1", None, True), ("o0", None, True)] and state.kept != kept
    state.now = 1400
    assert met([]) == [("o4", None, True)]
    state.hasTimedOut, kept = False, state.kept
    assert met([("2", "order", "o6", 500)]) == [("o6", "c2b", False)] and state.kept is kept         # nothing new: nothing written
    assert late.json.loads(late.zlib.decompress(state.kept[1])) == [] 


def test_calls_do_not_follow_the_keys(spark, sf_small, folder):
    path, folders = folder
    prep = features.fit_prep(common.raw(spark, sf_small))
    for t in ("orders", "customer"):
        for part in range(3):                                   # part files share a micro-batch, which bytes bound
            add(spark.read.parquet(f"{sf_small}/{t}.parquet").where(f"{'o_orderkey' if t == 'orders' else 'c_custkey'} % 3 = {part}"), path, t)
    scores, dead = late.late_scores(spark, path, prep, folders=folders)
    assert len(os.listdir(f"{folders[0]}/scores")) <= 2 and scores.count() == common.raw(spark, sf_small).count()
