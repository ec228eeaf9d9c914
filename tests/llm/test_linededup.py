import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskframe.llm import linededup

SCHEMA = "doc_id long, text string, k1 string, n_lines string"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, keep_first):
    where, lines_of = defaultdict(list), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        lines_of[i, text] = lines
        for p, line in enumerate(lines):
            if key := line.strip(WHITE).translate(LOWER):
                where[key].append(((i, text), p))
    gone = defaultdict(set)
    for places in where.values():
        if len({d for d, _ in places}) >= min_docs:
            for d, p in places[int(keep_first):]:
                gone[d].add(p)
    return sorted([(repr(i), "\n".join(x for p, x in enumerate(lines_of[i, t]) if p not in gone[i, t]), len(lines_of[i, t]), len(gone[i, t]))
                   for i, t in rows])


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    out = linededup.dedup_lines(df, **kw).collect()
    return sorted([(repr(r.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in out])


def sample(seed):
    rng = random.Random(seed)
    pool = ["Hot", " hot\t", "", "a", "b", "B", "c c", "É", "é", *(f"line {i}" for i in range(30))]
    weights = [60, 30] + [5] * (len(pool) - 2)
    rows = [(i, "\n".join(rng.choices(pool, weights, k=rng.randrange(0, 12)))) for i in range(300)]
    return rows + rows[:5] + [(1000, None), (None, "hot\nx"), (None, None), (1001, "z\n" * 3000), (1002, "")]


@pytest.mark.parametrize("min_docs,keep_first", [(10, False), (2, True), (1, False)])
def test_against_brute_force(spark, min_docs, keep_first):
    rows = sample(min_docs)
    assert got(spark, rows, min_docs=min_docs, keep_first=keep_first) == brute(rows, min_docs, keep_first)


def test_runs_over_small_batches_and_many_ranges(spark):
    rows = sample(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        for keep_first in (True, False):
            assert got(spark, rows, min_docs=4, keep_first=keep_first) == brute(rows, 4, keep_first)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_bitmaps_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\na"), (2, "a")], "doc_id long, text string")
    rows = {r.n_lines: r for r in linededup.keep_bitmaps(df, 2, False).collect()}
    assert np.unpackbits(np.frombuffer(zlib.decompress(rows[3].keep), np.uint8), count=3).tolist() == [0, 1, 0]
    assert rows[1].n_dropped == 1
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_query(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, g in brute(docs, 10, False)]
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op9_line_dedup"](spark, sf_small).collect()) == want


def test_bitmaps_over_columns_of_any_name(spark):
    rows = [(i, f"same\nown {i}", 7, b"x", 9, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, keep binary, k1 int, n_dropped int")
    got = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df, min_docs=3, keep_first=False))
    assert got.columns == ["doc_id", "text", "keep", "k1", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(i, f"own {i}", b"x", 9, 2, 1) for i in range(4)]


def test_a_text_of_many_equal_lines(spark):
    df = spark.createDataFrame([(1, "x\n" * 200_000), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df, min_docs=3, keep_first=False).collect()}
    assert got == {1: (200_001, 0), 2: (1, 0)}
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df, min_docs=2, keep_first=True).collect()}
    assert got == {1: (200_001, 199_999), 2: (1, 1)}
