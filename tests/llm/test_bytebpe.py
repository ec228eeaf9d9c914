import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from riskframe.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    pick = [" ", "  ", "\n", "\t", "a", "b1", "x.", "\x1c", "\x85", "\xa0", "é", "don't", "ÜBER", "123", "🙂", "漢字", "▁", "</s>", "<unk>", "\x00", "ſ"]
    return ["".join(rng.choices(pick, k=rng.randrange(0, 25))) for _ in range(3000)] + ["a" * 30000, " " * 3000 + "x", "", "word " * 20000, "x \n y", " lead", "trail "]


def test_ids_equal_the_library_and_decode(library):
    c = bytebpe.Codec(PATH, P.PATTERN)
    for t, ids in zip(texts(), c.encode_all(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_other_vocabulary():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    c = bytebpe.Codec(path, P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_all(texts()[:500])] == [lib.encode_ordinary(t) for t in texts()[:500]]


def test_cache_stays_bounded(library):
    c = bytebpe.Codec(PATH, P.PATTERN)
    c.parts.limit = c.cache.limit = 50
    for t in texts()[:300]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    assert len(c.parts) <= 100


def test_frames(spark, library):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "no id"), (1, "Hello  world"), (4, "long " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bytebpe.encode(df, PATH, P.PATTERN)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got.collect()) == sorted((repr(i), len(library.encode_ordinary(t or ""))) for i, t in rows)
    assert sorted(bytes(r.text) for r in bytebpe.decode(got, PATH, P.PATTERN).collect()) == sorted((t or "").encode() for _, t in rows)
    assert bytebpe.round_trip(df.limit(0), PATH, P.PATTERN).collect() == []


def test_query(spark, sf_small, library):
    from riskframe.llm.queries import QUERIES
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, sf_small).collect():
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
