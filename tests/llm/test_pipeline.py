"""Each stage against a plain version, on its own input."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_decontam import brute as overlaps_brute
from test_linededup import brute as lines_brute
from test_simhash import slow_components, slow_fingerprint

from riskframe.llm import bytebpe, stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    en, fr = "the of and to in is that it was for on are".split(), "le la les des est une dans que qui pour sur avec".split()
    item = " ".join(rng.choices(en, k=30))
    rows = []
    for i in range(80):
        v, lang = (en, "en") if i % 3 else (fr, "fr")
        lines = [" ".join(rng.choices([*v, f"{lang}{rng.randrange(500)}"], k=rng.randrange(4, 30))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines + (["common line"] if i % 4 == 0 else [])), lang))
    rows += [(100, rows[5][1], "en"), (101, rows[5][1].upper(), "en"), (102, "intro words " + item.upper() + " end", "en"), (103, None, "en"), (104, "", None),
             (105, "123 456", "en"), (None, "the of and that has no id of its own", None), (6, rows[6][1], "en"), (106, "common line", "en")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    one = stages.language_id(spark, docs, folder)
    assert one.columns == columns
    assert pairs(one) == sorted([x for x in pairs(docs) if any(c.isalpha() for c in x[1] or "")], key=repr)
    assert all(r.lang in ("en", "fr") for r in one.collect())

    two = stages.line_dedup(spark, one, folder)
    assert two.columns == columns
    want = lines_brute(pairs(one), 10, True)
    assert sorted((repr(i), t) for i, t in pairs(two)) == sorted((i, t) for i, t, _, _ in want)
    assert sum(x[3] for x in want) >= 15
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = stages.simhash_dedup(spark, two, folder)
    assert three.columns == columns
    rows = sorted(set(pairs(two)), key=repr)
    fps = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fps, list(range(len(rows))), 4)
    low = {}
    for g, x in zip(group, rows, strict=True):
        low[g] = min(low.get(g, x), x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert pairs(three) == sorted(low.values(), key=repr)
    assert {100, 101} & {i for i, _ in pairs(three)} == set()

    four = stages.decontaminate(spark, three, folder)
    assert four.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, _ in overlaps_brute(pairs(three), items)}
    assert 102 in bad and pairs(four) == [x for x in pairs(three) if x[0] not in bad]

    five = {r.doc_id: r for r in stages.byte_bpe(spark, four, folder).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, t in pairs(four):
        ids = enc.encode_ordinary(t)
        assert np.frombuffer(five[i].ids, "<u4").tolist() == ids and five[i].n_tokens == len(ids)
        assert five[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run(spark, folder):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted((repr(r.doc_id), bytes(r.ids)) for r in docs.collect())
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for stage in (stages.language_id, stages.line_dedup, stages.simhash_dedup, stages.decontaminate, stages.byte_bpe):
        assert stage(spark, docs, folder).collect() == []


def test_without_labels_texts_with_letters_stay(spark, folder):
    rows = [(1, "the of and", None, "s", 10), (2, "123 456", None, "s", 7), (3, None, None, "s", 0), (4, "\u4f60\u597d", None, "s", 2), (5, "", None, "s", 0)]
    got = stages.language_id(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(1, "the of and", "und"), (4, "\u4f60\u597d", "und")]
