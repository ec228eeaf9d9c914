import math
import random
import re
from collections import Counter

import pytest

from riskframe.llm import lexical

SCHEMA = "doc_id long, text string, block long, term string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    nn, ll, df = len(bags), sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        w = {t: math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for i, bag, n in bags:
            m = 10 + 90 * n * nn // ll
            score = sum(w[t] * (10 ** 9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in w if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, *_, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


def sample(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(80)] + ["The", "the", "THE", "é", "É", "日本", "x-y", "a1", "_z_"]
    weights = [1 / (1 + i) for i in range(80)] + [3, 3, 3, 1, 1, 1, 1, 1, 1]
    docs = [(i, " ".join(rng.choices(pool, weights, k=rng.randrange(0, 40)))) for i in range(400)]
    docs += docs[:5] + [(7, "w1 w2"), (1000, None), (None, "w1 w79"), (None, None), (1001, ""), (1002, "-- ,"), (1003, "w3 w4 " * 30_000), (1004, "\x00w5\x7fw6")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 15)))) for i in range(40)]
    items += items[:2] + [(3, "w1 other"), (None, "w79 w5"), (500, None), (501, "nowhere at-all"), (502, "w1 W1 w1"), (503, "")]
    return docs, items


@pytest.mark.parametrize("k,stages,block,chunk", [(10, 4, 1 << 23, 1024), (3, 1, 2000, 7), (5, 6, 300, 20)])
def test_against_brute_force(spark, k, stages, block, chunk):
    docs, items = sample(k)
    d = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rank string")
    got = lexical.search(d, q, k, stages, block, chunk).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs, items, k)


def test_pruning_keeps_ties(spark):
    docs = [(i, "rare common") for i in range(30)] + [(100 + i, "common") for i in range(50)]
    items = [(1, "rare common"), (2, "common")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(repr(tuple(r)) for r in lexical.search(d, q, 10, 4, 200).collect()) == brute(docs, items, 10)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(d, some).collect() == []
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), q).collect() == []


def test_long_norms_stay_whole():
    import numpy as np
    sizes, n, total = np.array([1, 10 ** 9], np.int64), 10 ** 10, 10 ** 12
    assert lexical.norms(sizes, n, total).tolist() == [10 + 90 * s * n // total for s in sizes.tolist()]
