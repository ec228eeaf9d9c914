import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from riskframe.llm import rans

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,ids", [(0, 3), (1, 1), (2047, 2), (2049, 40), (600_000, 3000)])
def test_coder_round_trip_from_every_checkpoint(n, ids):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.geometric(0.01, n), ids).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(x, minlength=5)))
    stream, marks = coder.encode(x)
    parts = [coder.decode(stream, marks, n, p) for p in range(len(marks))]
    assert np.array_equal(np.concatenate(parts) if parts else [], x)
    if n > 100_000:
        assert len(marks) == 3
        p = np.bincount(x) / n
        p = p[p > 0]
        assert len(stream) * 8 < 1.02 * n * -(p * np.log2(p)).sum()
        with pytest.raises((ValueError, IndexError)):
            coder.decode(b"\1" + stream[1:], marks, n, 0)


def test_words_equal_the_library(sf_small):
    rng = random.Random(1)
    pieces = ["a", "B's", "don't", "É", "é", "1234", "...", " ", "\n", "\t", "\x1c", "İx", "ß.", "x!!", "ÀÉÑ,", "Œuvre", "straße", "e\u0301", "ŉa", "ªº", "\u0130", "<|endoftext|>", "'s", "a.'s", "　", "Σ", "ΑΣ", "-", "🙂."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 12))) for _ in range(4000)] + ["x" * 20000, "", "A. " * 9000]
    t = Tokenizer.from_file(PATH)
    w = rans.Words(PATH)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode_all(texts)] == want


def check(rows, got):
    t = Tokenizer.from_file(PATH)
    ids = {r: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in set(rows)}
    total = 0
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == total
        total += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(r[0]), len(ids[r]), crc(ids[r])) for r in rows)


def test_files(spark, monkeypatch):
    rows = [(i * 7 % 50, f"Text {i}, of  no\nlength " * (i % 5)) for i in range(50)] + [(3, "again"), (3, "again"), (None, "no id"), (60, None), (61, ""), (62, "long one " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string").repartition(3)
    folder = rans.write_ids(df, PATH)
    check(rows, rans.read_ids(spark, folder, digest=True).collect())
    full = {r.doc_id: r.ids for r in rans.read_ids(spark, folder).collect()}
    assert np.frombuffer(full[61], "<u4").tolist() == [2]
    assert rans.read_ids(spark, rans.write_ids(df.limit(0), PATH), digest=True).collect() == []


def test_query(spark, sf_small):
    from riskframe.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(rows, QUERIES["op4_rans"](spark, sf_small).collect())


def test_special_tokens_in_other_case():
    texts = ["<|ENDOFTEXT|>x", "<|endoftext|>x", "a<|EndOfText|>b C", "<|startOFtext|>Ab", "X<|Y"]
    w = rans.Words(PATH)
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode_all(texts)] == want
