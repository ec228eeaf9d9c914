import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskframe.llm import recompress


def brute(rows, width):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((repr(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def sample(seed, vocab):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    passages = [rng.choices(words, k=rng.randrange(20, 90)) for _ in range(6)] + [["x"] * 80, ["x", "y"] * 50, ["a"] * 33 + ["b"]]
    rows = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(0, 4)):
            body += rng.choices(words, k=rng.randrange(0, 60))
            p = rng.choice(passages)
            a, b = rng.randrange(0, 10), rng.randrange(0, 10)
            body += p[a:len(p) - b]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(body)))
    return rows + rows[:2] + [(90, None), (91, ""), (None, rows[3][1]), (92, "z " * 300), (93, "É\x85x " * 40)]


@pytest.mark.parametrize("seed,vocab,width", [(1, 1000, 35), (2, 3, 35), (3, 30, 12), (4, 1, 35), (5, 2, 13)])
def test_against_brute_force(spark, seed, vocab, width):
    rows = sample(seed, vocab)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k1 string").repartition(3)
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.text) for r in recompress.cut_repeats(df, width).collect())
    assert got == brute(rows, width)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(recompress, "PIECE", 50)
    rows = sample(9, 40)
    x = [recompress.word_names(t) for _, t in rows]
    sets = []
    for piece in (50, 1 << 17):
        monkeypatch.setattr(recompress, "PIECE", piece)
        found = set()
        for row, off, names in recompress._pieces(x, 35):
            seq, name, _, first, count = recompress.anchors(names, np.array([len(names)]), 35)
            found |= {(row, off + f + k, n) for f, c, n in zip(first.tolist(), count.tolist(), name.tolist(), strict=True) for k in range(c)}
        sets.append(found)
    assert sets[0] == sets[1] and len(sets[0]) == sum(max(0, len(v) - 34) for v in x)


def test_rounds_shorten(spark):
    x = recompress.word_names(" ".join(map(str, range(5000))))
    fresh = np.zeros(5000, bool)
    fresh[0] = True
    assert len(recompress.boundaries(x, fresh)) < 3200
    run = np.full(100, x[0])
    assert recompress.boundaries(run, fresh[:100]).tolist() == [0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert recompress.cut_repeats(df).collect() == []


def test_query_and_oracle(spark, sf_small):
    from riskframe.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op8_recompression"](spark, sf_small).collect())
    assert got == sorted(con.execute(ORACLE["op8_recompression"]).fetchall())
    assert sum(r[2] for r in got) > 0
