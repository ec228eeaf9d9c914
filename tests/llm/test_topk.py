import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from riskframe.llm import topk


def brute(rows, k, scale=64.0):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    z = [(i, v, [math.floor(scale * x) for x in v]) for i, v in ok]
    out = []
    for i, v, a in z:
        if i % 20 == 0:
            s = sorted([(-sum(x * y for x, y in zip(a, b)), j) for j, u, b in z if (j, u) != (i, v) and len(u) == len(v)])[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def vectors(seed, n, dims, spread):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 1]) * round(rng.random() * spread, 2) for _ in range(dims)]) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] + [0.0] * (dims - 1)), (None, [0.5] * dims),
                   rows[0], rows[7], (40, [0.25] * dims), (2000, [0.0] * dims), (2020, []), (2021, []), (2040, [1.0] * (dims + 1))]


@pytest.mark.parametrize("seed,n,dims,spread,block,queries", [(1, 700, 8, 0.4, 100, 7), (2, 300, 3, 0.05, 8192, 1024), (3, 400, 64, 0.3, 250, 1024), (4, 15, 4, 1, 5, 1), (5, 200, 5, 1e6, 90, 50)])
def test_against_brute_force(spark, seed, n, dims, spread, block, queries):
    rows = vectors(seed, n, dims, spread)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block=block, queries=queries).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(brute(rows, 20))


def test_stops_before_the_lists_end():
    import numpy as np
    v = np.random.default_rng(1).integers(-64, 65, (5000, 4)).astype(float)
    v[17] = 1000.0
    score, where, met = topk._search(v, np.arange(5000), np.ones((1, 4)), np.array([-1]), 1)
    assert where.tolist() == [[17]] and score[0, 0] == 4000 and met <= 4 * topk.FIRST_DEPTH


def test_ties_in_the_order_of_positions():
    import numpy as np
    rng = np.random.default_rng(2)
    score, where = rng.integers(-3, 4, (50, 400)), np.broadcast_to(np.arange(400), (50, 400))
    want = np.sort(np.lexsort((where, -score), axis=1)[:, :20], axis=1)
    assert (np.sort(topk._best(score, where, 20, 400)[1], axis=1) == want).all()
    assert (np.sort(topk._best(score * 10 ** 17, where, 20, 400)[1], axis=1) == want).all()


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).collect() == []
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(big, F.col("vec_id") % 20 == 0).collect()


def test_query_and_oracle(spark, sf_small):
    from riskframe.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op5_threshold_topk"](spark, sf_small).collect())
    assert got and got == sorted(con.execute(ORACLE["op5_threshold_topk"]).fetchall())
