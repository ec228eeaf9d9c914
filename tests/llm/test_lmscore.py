import math
import random
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import lmscore
from riskframe.llm.common import gram_buckets

ORDER, BITS, WEIGHT = 4, 18, 2.0


def bucket(gram):
    return int(gram_buckets(np.array(gram, np.uint32), len(gram), BITS)[-1][-1])


def grams(text):
    x = [0] * (ORDER - 1) + [ord(c) + 1 for c in text or ""]
    return [[tuple(x[i - k + 1:i + 1]) for k in range(1, ORDER + 1)] for i in range(ORDER - 1, len(x))]


def brute(docs, wanted):
    count = [[Counter() for _ in range(ORDER + 1)] for _ in range(2)]
    size = [0, 0]
    for d, t in docs:
        for side in (0, 1) if d in wanted else (1,):
            if t:
                for k in range(1, ORDER):
                    count[side][k][bucket((0,) * k)] += 1
            for g in grams(t):
                size[side] += 1
                for k, x in enumerate(g, 1):
                    count[side][k][bucket(x)] += 1
    matched = size[0] / size[1] if size[0] else 1.0
    total = [size[0], size[1] * matched]
    vocabulary = len(count[1][1])
    out = []
    for d, t in docs:
        g = grams(t)
        means = []
        for m in range(2):
            f = matched if m else 1.0
            loss = 0.0
            for x in g:
                p = 1 / vocabulary
                for k in range(1, ORDER + 1):
                    seen = total[m] if k == 1 else f * count[m][k - 1][bucket(x[k - 1][:-1])]
                    p = (f * count[m][k][bucket(x[k - 1])] + WEIGHT * p) / (seen + WEIGHT)
                loss -= math.log(p)
            means.append(loss / len(g) if g else None)
        out.append((d, len(g), *means, means[0] - means[1] if g else None))
    return out


@pytest.mark.parametrize("piece", [1 << 21, 50])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(lmscore, "PIECE", piece)
    rng = random.Random(2)
    docs = [(i, "".join(rng.choices("abcd é\U0001F600" if i % 3 else "aab ", k=rng.randrange(0, 160)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "aab"), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(2)
    wanted = {i for i in range(60) if i % 3 == 0}
    ids = spark.createDataFrame([(i, "x") for i in [*wanted, 0, None, 999]], "doc_id long, text string")
    got = lmscore.cross_entropy_difference(df, ids, ORDER, BITS, WEIGHT).collect()
    want = {d[0]: d[1:] for d in brute(docs, wanted)}
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id], abs=1e-9), r.doc_id
    scores = {r.doc_id: r.score for r in got if r.score is not None}
    assert max(scores[i] for i in wanted if i in scores) < min(v for i, v in scores.items() if i is not None and i not in wanted and v)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.cross_entropy_difference(df.limit(0), none).collect() == []
    r = lmscore.cross_entropy_difference(df, none).collect()[0]
    assert r.n_tokens == 2 and r.loss_target == pytest.approx(math.log(3))      # uniform over a, b and the start


def test_query(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    rows = QUERIES["op6_lm_scoring"](spark, sf_small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t or "") for i, t in docs.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    mean = lambda q: np.mean([r.score for r in rows if labels.get(r.doc_id) == q and r.score is not None])
    assert mean(1) < mean(0)


def test_grams_do_not_share_counts(spark, monkeypatch):
    """More distinct grams than any fixed number of buckets keeps apart: a count for each gram itself."""
    rng = random.Random(5)
    docs = [(i, "".join(chr(0x4E00 + rng.randrange(6000)) for _ in range(2000))) for i in range(40)]
    wanted = set(range(0, 40, 2))
    ids = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    got = lmscore.cross_entropy_difference(spark.createDataFrame(docs, "doc_id long, text string"), ids, ORDER, weight=WEIGHT).collect()
    monkeypatch.setitem(globals(), "bucket", lambda gram: gram)
    want = {d[0]: d[1:] for d in brute(docs, wanted)}
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id], abs=1e-9), r.doc_id
