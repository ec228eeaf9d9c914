import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from riskframe.llm import components, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, max_bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            low[r] = min(low.get(r, x), x)
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprint_is_the_bitwise_majority(spark):
    texts = ["a", "A b", "x y z w v", "É Ü\x1cz q a b c d e", "", None, " \n\t", "w " * 70000, "ab\x0bcd\x0cef gh ij"]
    assert [simhash.fingerprint(t, 4) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_cover_reaches_every_choice():
    for matches, width in ((4, 3), (5, 4), (2, 1), (1, 1)):
        sets = simhash.cover(matches, width)
        assert all(any(set(s) <= set(x) for s in sets) for x in itertools.combinations(range(8), matches))


@pytest.mark.parametrize("max_bits,limit", [(4, 1 << 16), (4, 3), (2, 3), (7, 1 << 16)])
def test_links_span_the_same_components(spark, monkeypatch, max_bits, limit):
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 25])):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps) + [0]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "LONG_LIST", limit)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in components.components(simhash.links(df, max_bits), "a", "b").collect()}
    want = slow_components(fps, signed, max_bits)
    assert [root.get(x, x) for x in signed] == want


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=200)) for _ in range(12)]
    texts = []
    for b in base:
        w = b.split()
        texts += [b, b.upper(), " ".join(w[:100] + ["new"] + w[100:]), " ".join(w[::-1])]
    texts += [None, "", "  ", "one", "one", "One two", base[0]]
    rows = [(100 + i, t, "junk", i) for i, t in enumerate(texts)] + [(None, base[1], "junk", 1), (None, "lonely text of no id", "x", 1), (101, texts[1], "junk", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp long")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert simhash.near_duplicates(df).count() == len(rows)
    fps = [slow_fingerprint(r[1]) for r in rows]
    comp = slow_components(fps, [r[0] for r in rows], 4)
    assert got == {(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True)}
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(300, 300), (None, 5), (400, 401), (401, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 260)} | {400: 400, 401: 400}


def test_query(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    comp = slow_components(fps, [r.doc_id for r in docs], 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_small).collect()}
    assert got == {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, comp, strict=True)}


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 1, 2, 3), (2, "a b c d e", 4, 5, 6), (3, "p q r s t u v", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k1 int, n int, __n int")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [rows[0], rows[2]]


def test_one_hot_list_is_split_down_to_nibbles(spark, monkeypatch):
    # all fingerprints share four bytes: the byte round leaves them in one list
    rng = np.random.default_rng(9)
    low = np.unique(rng.integers(0, 1 << 32, 1500, dtype=np.uint64))
    low = np.unique(np.concatenate([low, low[:700] ^ (np.uint64(1) << rng.integers(0, 32, 700).astype(np.uint64)) ^ np.uint64(0x01000100)]))
    fps = low | np.uint64(0xA5000F3C << 32)
    near = [fps[np.bitwise_count(fps ^ x) <= 4] for x in fps]
    want = {int(x): int(x) for x in fps}
    for _ in range(len(fps)):
        new = {int(x): min(want[int(y)] for y in ys) for x, ys in zip(fps, near, strict=True)}
        if new == want:
            break
        want = new
    monkeypatch.setattr(simhash, "LONG_LIST", 100)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components.components(simhash.links(df, 4), "a", "b").collect()}
    groups = {}
    for x, s in zip(fps, fps.view(np.int64), strict=True):
        groups.setdefault(root.get(int(s), int(s)), set()).add(want[int(x)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
    assert len(groups) < len(fps) - 600
