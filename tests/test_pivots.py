"""Exact neighbours by the pivot index, against all pairs."""

import math
import random

import pytest

from riskframe.operators import neighbors, pivots


def brute(points, k):
    out = []
    for i, x in points:
        away = []
        for j, y in points:
            if i != j:
                total = 0.0
                for a, b in zip(x, y):
                    total += (a - b) ** 2
                away.append((math.sqrt(total), j))
        out += [(i, r, j, round(s, 9)) for r, (s, j) in enumerate(sorted(away)[:k], 1)]
    return sorted(out)


def got(spark, points, k, **kw):
    d = len(points[0][1])
    df = spark.createDataFrame([(i, *map(float, x), 1) for i, x in points], "id long, " + ", ".join(f"`c {i}` double" for i in range(d)) + ", f0 int").repartition(3)
    return sorted((r.id, r["rank"], r.neighbor_id, round(r.distance, 9)) for r in pivots.knn(df, [f"c {i}" for i in range(d)], k, **kw).collect())


def table(seed, n, numbers, levels):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(numbers)]
        for size in levels:
            v = rng.randrange(size)
            x += [float(v == j) for j in range(size)]
        rows.append((i * 3, x))
    return rows


@pytest.mark.parametrize("n,numbers,levels,kw", [
    (400, 8, (4, 5, 3, 5, 9), {"sample": 40, "n_pivots": 6, "block": 30}),       # 34 columns
    (300, 2, (), {"sample": 10, "n_pivots": 3, "block": 12}),
    (200, 0, (3, 4), {"sample": 5, "n_pivots": 4, "block": 4}),                   # many equal points
    (120, 3, (2,), {}),
    (4, 2, (), {"sample": 2, "n_pivots": 2, "block": 1})])
def test_exact(spark, n, numbers, levels, kw):
    points = table(n, n, numbers, levels)
    assert got(spark, points, 5, **kw) == brute(points, 5)


def test_far_outlier_and_clusters(spark):
    rng = random.Random(9)
    points = [(i, (rng.random() * 0.2, rng.random() * 0.2)) for i in range(100)] + [(500, (-1e18, 0.0)), (501, (50.0, 50.0)), (502, (50.0, 50.1))]
    assert got(spark, points, 3, sample=20, n_pivots=4, block=10) == brute(points, 3)
    df = spark.createDataFrame([(i, *x) for i, x in points], "id long, a double, b double")
    assert sorted((r.id, r["rank"], r.neighbor_id, round(r.distance, 9)) for r in neighbors.knn(df, ["a", "b"], 3, max_cell=20).collect()) == brute(points, 3)


def test_single_empty_and_null(spark):
    df = spark.createDataFrame([(1, 1.0)], "id long, a double")
    assert pivots.knn(df, ["a"], 3).collect() == [] and pivots.knn(df.limit(0), ["a"], 3).collect() == []
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "id long, a double")
    assert sorted((r.id, r.neighbor_id) for r in pivots.knn(df, ["a"], 3).collect()) == [(1, 3), (3, 1)]


def test_a_location_asks_only_leaves_within_its_bound(spark):
    """Levels cut the table: the asks grow with the rows, not with pairs of blocks."""
    asked, points = {}, table(7, 4000, 2, (3, 4, 3))
    import numpy as np
    for n in (1000, 4000):
        x = np.array([p for _, p in points[:n]])
        nodes = pivots.grow(x, 40)
        leaf = pivots.leaf_of(nodes, x)
        kinds = [len({tuple(r[2:]) for r in x[leaf == i]}) for i in range(leaf.max() + 1)]
        assert min(kinds) >= 1 and sum(k == 1 for k in kinds) > len(kinds) // 2        # most leaves hold one combination of levels
        low, high = (np.array([f(x[leaf == i], axis=0) for i in range(leaf.max() + 1)]) for f in (np.min, np.max))
        ask = pivots._ask(x[:50], x[:2], np.arange(len(low)), np.hstack([low, 0 * low[:, :2]]), np.hstack([high, 0 * high[:, :2] + 1e9]), 6, x.shape[1])
        import pyarrow as pa
        mine = pa.record_batch({"leaf": pa.array([0], pa.int32()), "part": [0], "parts": [1], "locs": [np.nonzero(leaf == 0)[0].astype("<i8").tobytes()], "at": [x[leaf == 0].tobytes()]})
        out = next(ask(iter([mine]))).to_pylist()
        asked[n] = sum(len(r["q_locs"]) // 8 for r in out[1:]) / (leaf == 0).sum() / len(low)
    assert asked[4000] < 0.25


def test_a_location_travels_once_to_a_block(spark):
    """A block of several leaves is asked once by a location, whatever number of its leaves the bound reaches."""
    import numpy as np
    import pyarrow as pa
    x = np.array([p for _, p in table(11, 3000, 4, (3, 4))])
    nodes = pivots.grow(x, 60)
    leaf = pivots.leaf_of(nodes, x)
    boxes, n_blocks = leaf.max() + 1, 4
    of = np.arange(boxes, dtype=np.int32) * n_blocks // boxes
    low, high = (np.array([f(x[leaf == i], axis=0) for i in range(boxes)]) for f in (np.min, np.max))
    low, high = np.hstack([low, np.zeros((boxes, 2))]), np.hstack([high, np.full((boxes, 2), 1e9)])
    mine = np.nonzero(of[leaf] == 1)[0]
    batch = pa.record_batch({"leaf": pa.array([1], pa.int32()), "part": [0], "parts": [1], "locs": [mine.astype("<i8").tobytes()], "at": [x[mine].tobytes()]})
    out = next(pivots._ask(x[:50], x[:2], of, low, high, 6, x.shape[1])(iter([batch]))).to_pylist()[1:]
    pairs = [(r["leaf"], q) for r in out for q in np.frombuffer(r["q_locs"], "<i8").tolist()]
    assert len(pairs) == len(set(pairs)) and {b for b, _ in pairs} <= {0, 2, 3}
    # who asks has a leaf there within its bound; who does not, has none
    bound = np.sort(np.sqrt(((x[mine][:, None] - x[mine][None]) ** 2).sum(2)), axis=1)[:, 5]
    for b in (0, 2, 3):
        off = np.maximum(np.maximum(low[of == b, None, :-2] - x[mine], x[mine] - high[of == b, None, :-2]), 0)
        assert {q for to, q in pairs if to == b} == set(mine[(np.sqrt((off ** 2).sum(2)) <= bound * (1 + 1e-8)).any(axis=0)].tolist())


def test_large_leaves_are_dealt_over_blocks():
    import numpy as np
    assert pivots.into_blocks(np.array([3, 4, 5, 25, 2, 9]), 10) == [[0], [0], [1], [2, 3, 4], [5], [6]]


def test_many_askers_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 20)
    monkeypatch.setattr(pivots, "PACK", 7)
    points = table(5, 400, 6, (4, 3))
    assert got(spark, points, 5, sample=40, n_pivots=3, block=25) == brute(points, 5)


def test_passes_do_not_follow_the_scales_of_the_data(spark):
    """Points whose gaps double from one to the next take no more jobs than points of one scale."""
    jobs = {}
    for name, gap in (("even", 1.0), ("doubling", 1.5)):
        points = [(i, (gap ** i if gap > 1 else float(i), float(i % 3))) for i in range(48)]
        df = spark.createDataFrame([(i, *x) for i, x in points], "id long, a double, b double")
        spark.sparkContext.setJobGroup(f"knn-{name}", name)
        try:
            out = sorted((r.id, r["rank"], r.neighbor_id, round(r.distance, 9)) for r in neighbors.knn(df, ["a", "b"], 3, max_cell=20).collect())
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert out == brute(points, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"knn-{name}"))
    assert 0 < jobs["doubling"] <= jobs["even"] + 5
