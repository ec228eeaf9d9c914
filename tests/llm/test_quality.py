import base64
import random
import re
from collections import Counter

import zstandard

from riskframe.llm import quality

SCHEMA = "doc_id long, text string, ratio string, kept string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def verdict(text):
    raw, zip_ = (text or "").encode(), zstandard.ZstdCompressor(level=quality.LEVEL).compress
    if not raw:
        return True
    low, high = next((a, b) for below, a, b in quality.BANDS if len(raw) < below)
    ok = low <= len(zip_(raw)) / len(raw) <= high
    cuts = [raw[i:i + quality.CHUNK] for i in range(0, len(raw), quality.CHUNK)]
    if len(cuts) > 1 and len(cuts[-1]) < quality.CHUNK // 2:
        cuts[-2:] = [cuts[-2] + cuts[-1]]
    if len(cuts) > 1:
        a, b = quality.CHUNK_LIMITS
        ok = ok and 100 * sum(not a <= len(zip_(c)) / len(c) <= b for c in cuts) <= quality.BAD_CHUNKS * len(cuts)
    return ok


def prose(rng, n):
    pool = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(400)]
    return " ".join(rng.choices(pool, k=n))


def sample():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \t\n\n\x0b\x0c\r#|é日 \x1c\x85", k=rng.randrange(0, 80))) for _ in range(300)]
    texts += [prose(rng, n) for n in (49, 50, 60, 300, 900, 5000, 40_000)]
    texts += ["again and " * n for n in (10, 100, 5000)] + [base64.b64encode(rng.randbytes(n)).decode() for n in (300, 3000, 60_000)]
    texts += [prose(rng, 1000) + base64.b64encode(rng.randbytes(40_000)).decode(), prose(rng, 8000) + " the same" * 300, "x\n" * 5000, "a a a a", "a b c a b", "日本 " * 3000]
    return [(i, t) for i, t in enumerate([*texts, None, ""])] + [(None, "a b"), (None, None), (0, texts[0]), (0, texts[0])]


def test_counts_and_verdict_against_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = quality.judge(df).collect()
    want = []
    for i, t in rows:
        c = brute(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append(repr((i, *c, failed, verdict(t), not failed and verdict(t))))
    keys = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "in_bands", "kept")
    assert sorted(repr(tuple(r[k] for k in keys)) for r in got) == sorted(want)


def test_prose_stays_and_junk_goes(spark):
    rng = random.Random(5)
    good = [prose(rng, n) for n in (60, 120, 500, 2000, 20_000)]
    coded = base64.b64encode(rng.randbytes(50_000)).decode()
    bad = ["buy now cheap " * 400, " ".join(coded[i:i + 9] for i in range(0, 40_000, 9)), prose(rng, 600) + " " + " ".join(coded[i:i + 9] for i in range(0, 40_000, 9))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(len(good)))


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).collect() == []
