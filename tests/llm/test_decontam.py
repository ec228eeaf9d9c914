import itertools
import random
import re

import pytest

from riskframe.llm import decontam


def toks(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = toks(t)
        for i, x in items:
            v = toks(x)
            if len(v) < decontam.SHORTEST:
                continue
            width = min(len(v), decontam.WINDOW)
            best = 0
            for s in range(-len(v) + 1, len(w)):
                eq = [0 <= s + k < len(w) and w[s + k] == v[k] for k in range(len(v))]
                best = max(best, max(sum(eq[j:j + width]) for j in range(len(v) - width + 1)))
            if best >= decontam.SIMILARITY * width:
                out[d, i] = (best, width)
    return out


@pytest.mark.parametrize("size", [8, 10, 14, 15, 19, 20])
def test_masks_hit_every_tolerated_substitution(size):
    masks = decontam.MASKS if size >= decontam.WINDOW else decontam.SHORT_MASKS
    bits = [sum(1 << i for i, c in enumerate(m) if c == "1") << s for m in masks for s in range(size - len(m) + 1)]
    for gone in itertools.combinations(range(size), size // 5):
        lost = sum(1 << i for i in gone)
        assert any(not lost & b for b in bits)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([5, 8, 9, 12, 15, 20, 33, 50])]
    items += [(50, None), (51, ""), (52, "one two three"), (None, " ".join(rng.choices(vocab, k=25))), (6, items[6][1])]
    docs = []
    for i in range(120):
        body = rng.choices(vocab, k=rng.randrange(0, 120))
        v = toks(rng.choice(items)[1])
        for k in range(len(v)):
            if rng.random() < rng.choice([0, 0.1, 0.2, 0.4]):
                v[k] = "other"
        if rng.random() < 0.3:
            v = v[rng.randrange(0, 8):]
        at = rng.randrange(0, len(body) + 1)
        docs.append((i, rng.choice([" ", ", ", "\n### "]).join(body[:at] + [x.upper() for x in v] + body[at:])))
    docs += [(500, None), (501, ""), (None, items[5][1]), (502, items[7][1] + " tail"), (502, items[7][1] + " tail"), (503, "zz " * 5000 + items[4][1])]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = decontam.overlaps(d, b).collect()
    want = brute(docs, items)
    assert len(want) > 60
    assert {(r.doc_id, r.item_id): (r.matched, r.window) for r in got} == want
    assert len(got) == len(want)
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    bad = {x for x, _ in want}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(x[0]) for x in docs if x[0] not in bad)
    assert decontam.overlaps(d.limit(0), b).collect() == [] and decontam.overlaps(d, b.limit(0)).collect() == []


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "b c d e f g h i")], "item_id long, text string")
    one = decontam.overlaps(d, b).collect()
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert decontam.overlaps(d, b).collect() == one and one[0].doc_id == 1 and one[0].matched == 8


def test_query(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_small}/{t}.parquet").select(*(("doc_id", "text") if t == "documents" else ("item_id", "text"))).collect()]
    items = read("benchmark")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_window) for r in QUERIES["op10_decontaminate"](spark, sf_small).collect()}
    hit = {d for d, _ in got}
    docs = [x for x in read("documents") if x[0] in hit or len(toks(x[1])) < 150][:120]
    assert {k: v for k, v in got.items() if k[0] in {d for d, _ in docs}} == brute(docs, items)


@pytest.mark.parametrize("size", [1, 4, 5, 6, 7])
def test_little_masks_hit_every_tolerated_substitution(size):
    masks = decontam.little_masks(size)
    bits = [sum(1 << i for i, c in enumerate(m) if c == "1") << s for m in masks for s in range(size - len(m) + 1)]
    for gone in itertools.combinations(range(size), size // 5):
        assert any(not sum(1 << i for i in gone) & b for b in bits)


def test_short_items_and_unspaced_scripts(spark):
    han, kana, thai = "机器学习模型需要大量高质量的训练数据", "これはひらがなのぶんしょうです", "กขคงจฉชซ"
    items = [(1, "Paris"), (2, "one two three"), (3, "a b c d e f g"), (4, han), (5, kana), (6, thai), (7, "你好"), (8, " -- ")]
    docs = [(1, "I saw PARIS, again"), (2, "x one two three y"), (3, "one two four three"), (4, "0 a b c d e f g 1"), (5, "前文" + han + "后文"), (6, "前文" + han.replace("大量", "很多") + "后文"),
            (7, "まえ" + kana), (8, "ก" + thai + "ก"), (9, "说你好吗"), (10, "你不好"), (11, "Parisian"), (12, "model 数据 data")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in decontam.overlaps(d, b).collect()}
    assert got == {(1, 1): (1, 1), (2, 2): (3, 3), (4, 3): (7, 7), (5, 4): (18, 18), (6, 4): (16, 18), (7, 5): (15, 15), (8, 6): (8, 8), (9, 7): (2, 2)}
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [3, 10, 11, 12]


def test_shuffle_carries_no_text(spark, monkeypatch):
    long = " ".join(f"v{i % 997}" for i in range(20_000))
    items = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(100, 130))), (2, "nothing of the sort here at all my friend")], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (1, long), (2, "v1 v2"), (3, None)], "doc_id long, text string")
    want = sorted(map(tuple, decontam.overlaps(docs, items).select("doc_id", "item_id", "matched").collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    found = decontam.overlaps(docs, items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.split("\n") if "Join Inner" in x and "h#" in x)
    below = plan.split(join)[1].split("Relation")[0].split("LogicalRDD")[0].split("\n")
    carried = next(x for x in below if "Generate explode" in x)
    assert not re.search(r"[\[ ,]w#", re.search(r"\[h#.*", carried).group(0))        # no tokens beside the hash
    assert sorted(map(tuple, found.select("doc_id", "item_id", "matched").collect())) == want and want


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, __k1 int, k1 int, v0 int, c0 int")
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert [r.asDict() for r in decontam.clean(docs, items).collect()] == [r.asDict() for r in docs.collect()]
