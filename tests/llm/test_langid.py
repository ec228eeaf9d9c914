import itertools
import random
import zlib

import numpy as np
import pytest

from riskframe.llm import langid

EN = "the of and to in is that it was for on are with his they this have from not had".split()
FR = "le la les des est une dans que qui pour sur avec pas plus par nous vous mais être".split()
RU = "и в не на что быть он с это как по но они мы этот который из у".split()


def corpus(seed, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(v, k=rng.randrange(5, 60))), lang) for i, (v, lang) in enumerate(rng.choices([(EN, "en"), (FR, "fr"), (RU, "ru")], k=n))]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(corpus(1), "doc_id long, text string, lang string"))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (5, 0, 1, 7, 7, 3)]
    for s, got in zip(scores, langid.viterbi(scores, 2.0, 3), strict=True):
        cost = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((cost(p) for p in itertools.product(range(3), repeat=len(s))), default=0)
        assert len(got) == len(s) and cost(got) == pytest.approx(best, abs=1e-4)


def test_mixed_text_gives_spans(spark, model):
    rng = random.Random(4)
    text = " ".join(rng.choices(EN, k=30) + rng.choices(FR, k=40) + ["123", "--"] + rng.choices(RU, k=20))
    df = spark.createDataFrame([(1, text, "x"), (2, "", "x"), (3, None, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.start, s.end, s.lang) for s in r.spans] for r in langid.spans(df, model).collect()}
    assert [s[2] for s in got[1]] == ["en", "fr", "ru"] and got[1][-1][1] == 92
    assert abs(got[1][0][1] - 30) <= 2 and 70 <= got[1][1][1] <= 72
    assert got[2] == got[3] == []


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... 45"), (4, "ჰ ქართული"), (None, "the and of"), (5, "и в не"), (6, "the " * 40000), (5, "и в не"), (7, "\U0001F600 que la"), (8, "THE AND")]
    df = spark.createDataFrame([(*r, "fr", 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert len(got) == len(rows)
    by = {i: (lang, s) for i, lang, s in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] in ("en", "fr", "ru") and by[None][0] == "en" and by[5][0] == "ru" and by[7][0] == "fr" and by[8][0] == "en"
    assert by[6] == ("en", 1.0)
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.fit(df.limit(0)) is None and langid.predict(df.limit(0), model).collect() == []


def test_predictions_ignore_other_columns(spark, model):
    rows = corpus(3)
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    two = spark.createDataFrame([(i + 1000, t, "ru") for i, t, _ in rows], "doc_id long, text string, lang string")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, model).collect()} for d in (one, two))
    assert {i + 1000: v for i, v in a.items()} == b
    assert np.mean([a[i][0] == lang for i, _, lang in rows]) > 0.95


def test_query_held_out_accuracy(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    rows = QUERIES["op3_language_id"](spark, sf_small).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(out) > 20 and np.mean(out) >= 0.95
