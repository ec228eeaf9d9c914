import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import fillmiddle

SCHEMA = "doc_id long, text string, h string, n string, output string, form string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate, spm_rate, seed):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sample(seed):
    rng = random.Random(seed)
    letters = " \t\n\x0b\x0c\rab<P>SMé日\U0001f600  \x00\x85\x1c"
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 60)))) for i in range(400)]
    rows += [(1000 + i, f"one <{c}> two") for i, c in enumerate("PSMpsm")]
    return rows + rows[:5] + [(2000, None), (None, "a b c"), (None, None), (2001, ""), (2002, "  \n "), (2003, "word " * 200_000), (-7, "x < P> y <S")]


@pytest.mark.parametrize("rate,spm_rate,seed", [(50, 80, 42), (100, 50, 7), (0, 0, 1)])
def test_against_brute_force(spark, rate, spm_rate, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)
    got = fillmiddle.fill_in_middle(df, rate, spm_rate, seed)
    got = got.withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(map(repr, (brute(i, t, rate, spm_rate, seed) for i, t in rows)))
    assert sorted(repr(tuple(r)[:6]) for r in got) == want
    assert sorted(repr((r.doc_id, r.back)) for r in got) == sorted(repr((i, t or "")) for i, t in rows)


def test_empty_table_and_other_names(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(5, "a b c d")], "id int, body string")
    assert fillmiddle.fill_in_middle(df, 100, id_col="id", text_col="body").first().n == 4
