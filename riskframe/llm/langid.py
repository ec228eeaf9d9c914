"""Language identification with spans of mixed-language text.

Each word's script narrows the languages that may explain it; character-gram
scores rank those; a Viterbi pass with a penalty for every switch labels the
words, and neighbours of one label form a span.  A document's language is the
label with most letters.

The classifier is fitted on at most ``PER_LANGUAGE`` labelled documents a
language (those of least hash, whole texts); gram counts are in 2**BITS
buckets, so the model has a fixed size.  Prediction is map-only: every text
whole, documents of a slice side by side, step by step through their words.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where there was nothing to learn from; the score is the share of letters
under the predicted label; ties go to the first language in order; repeated
rows give repeated results; a null doc_id is passed on and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import top_k_per_group
from .common import Memo, documents, gram_buckets, slices

PER_LANGUAGE = 400
ORDER, BITS = 4, 15
SWITCH = 8.0                    # cost of a change of language, in nats
OTHER = -30.0                   # score of a word under a language whose script it isn't in
SHARE = 0.001                   # of a language's letters that a script needs to belong to it
UNKNOWN = "und"
SLICE = 3 << 20
#: Unicode ranges by script; letters elsewhere are one script more.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
STARTS = np.array([a for ranges in SCRIPTS.values() for a, _ in ranges])
ENDS = np.array([b for ranges in SCRIPTS.values() for _, b in ranges])
SCRIPT_OF = np.array([i for i, ranges in enumerate(SCRIPTS.values()) for _ in ranges])
BY_START = np.argsort(STARTS)


def scripts(codes: np.ndarray) -> np.ndarray:
    """Script number of each code point; ``len(SCRIPTS)`` for others."""
    at = np.searchsorted(STARTS[BY_START], codes, side="right") - 1
    found = BY_START[np.maximum(at, 0)]
    return np.where((at >= 0) & (codes <= ENDS[found]), SCRIPT_OF[found], len(SCRIPTS))


def letters(word: str) -> str:
    """The lower-cased letters of a word."""
    return word.lower() if word.isalpha() else "".join([c for c in word if c.isalpha()]).lower()


def _grams(words: list[str]):
    """Words laid end to end with a blank around each: codes, their word, and per
    order the buckets and which grams lie within one word."""
    text = " " + "  ".join(words) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(codes)) - begin
    return codes, sizes, [(b, inside >= k) for k, b in enumerate(gram_buckets(codes, ORDER, BITS))]


class Model:
    """Languages, the log-probability of each gram bucket, and the languages of each script."""

    def __init__(self, languages: list[str], grams: np.ndarray, script_counts: np.ndarray):
        self.languages = languages
        smooth = grams + 0.5
        self.table = np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32)      # order, language, bucket
        share = script_counts / np.maximum(script_counts.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= SHARE).T                                                       # script, language
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word under each language; zeros for a word without letters."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        has = np.flatnonzero([bool(w) for w in words])
        if not len(has):
            return out
        own = [words[i] for i in has]
        codes, sizes, orders = _grams(own)
        begin = np.cumsum(sizes) - sizes
        for language in range(len(self.languages)):
            total = np.zeros(len(codes), np.float32)
            for k, (b, inside) in enumerate(orders):
                total += np.where(inside, self.table[k, language][b], 0)
            out[has, language] = np.add.reduceat(total, begin) / ORDER
        script = scripts(codes[begin + 1])
        out[has] -= out[has].max(axis=1, keepdims=True)          # only differences matter
        out[has] = np.where(self.allowed[script], out[has], OTHER)
        return out


class Labeller:
    """Words to score rows (a bounded cache) and texts to labels."""

    def __init__(self, model: Model):
        self.model = model
        self.scores = Memo(self._rows, 1 << 17)

    def _rows(self, words: list[str]) -> list[tuple[bytes, int]]:
        plain = [letters(w) for w in words]
        rows = np.concatenate([self.model.word_scores(plain[i:i + 20000]) for i in range(0, len(plain), 20000)]) if plain else []
        return [(r.tobytes(), len(p)) for r, p in zip(rows, plain, strict=True)]

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: the language number of each word, and its letters."""
        cut = [(t or "").split() for t in texts]
        self.scores.fill({w for x in cut for w in x})
        get = self.scores.__getitem__
        found = [list(map(get, x)) for x in cut]
        count = [np.array([n for _, n in x], np.int64) for x in found]
        scores = [np.frombuffer(b"".join([s for s, _ in x]), np.float32).reshape(len(x), len(self.model.languages)) for x in found]
        return list(zip(viterbi(scores, SWITCH, len(self.model.languages)), count, strict=True))


def viterbi(scores: list[np.ndarray], penalty: float, states: int) -> list[np.ndarray]:
    """Best label sequence of each score matrix (words by languages); all sequences step together."""
    size = np.array([len(s) for s in scores], np.int64)
    rank = np.argsort(-size, kind="stable")
    steps = int(size.max(initial=0))
    if not steps:
        return [np.empty(0, np.int64) for _ in scores]
    flat = np.concatenate([s.reshape(-1, states) for s in scores])
    begin = (np.cumsum(size) - size)[rank]
    alive = np.searchsorted(-size[rank], -np.arange(steps), side="left")      # sequences longer than each step
    value = flat[begin].copy() if alive[0] == len(scores) else np.zeros((len(scores), states), np.float32)
    value[:alive[0]] = flat[begin[:alive[0]]]
    back: list = [None]
    own = np.arange(states, dtype=np.int16)
    for t in range(1, steps):
        n = alive[t]
        v = value[:n]
        top = v.argmax(axis=1)
        away = v[np.arange(n), top][:, None] - penalty
        stay = v >= away
        back.append(np.where(stay, own, top[:, None].astype(np.int16)))
        value[:n] = np.where(stay, v, away) + flat[begin[:n] + t]
    last = value.argmax(axis=1)
    path = np.empty(len(flat), np.int64)
    now = last.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        path[begin[:n] + t] = now[:n]
        if t:
            now[:n] = back[t][np.arange(n), now[:n]]
    ends = np.cumsum(size)
    return [path[e - n:e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on (doc_id, text, lang) rows with a language; None if there is none."""
    l = labelled.select(labelled["doc_id"].alias("doc_id"), labelled["text"].alias("text"), labelled["lang"].alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    # two rounds over hashed parts of a language: no task ranks a whole one
    chosen = top_k_per_group(l.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_language, "doc_id", rank_col="__n")
    chosen = chosen.select("doc_id", "lang").distinct()
    sample = l.join(F.broadcast(chosen), ["doc_id", "lang"])               # per_language rows a language at most
    shape = ORDER, 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = [p for p in map(letters, text.split()) if p]
                    grams, seen = np.zeros(shape, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)
                    for at in range(0, len(words), 20000):
                        codes, _, orders = _grams(words[at:at + 20000])
                        for k, (b, inside) in enumerate(orders):
                            grams[k] += np.bincount(b[inside], minlength=shape[1])
                        seen += np.bincount(scripts(codes[codes != 32]), minlength=len(seen))
                    k, b = np.nonzero(grams)
                    s = np.flatnonzero(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(k) + len(s)), pa.string()), pa.array(np.concatenate([k, np.full(len(s), -1)])),
                                                      pa.array(np.concatenate([b, s])), pa.array(np.concatenate([grams[k, b], seen[s]]))], names=["lang", "k", "bucket", "n"])

    counts = sample.mapInArrow(run, "lang string, k long, bucket long, n long").groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()                                                # ORDER * 2**BITS rows a language at most
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
    k, bucket, n = (rows.column(c).to_numpy() for c in ("k", "bucket", "n"))
    grams, seen = np.zeros((ORDER, len(languages), 1 << BITS)), np.zeros((len(languages), len(SCRIPTS) + 1))
    g = k >= 0
    grams[k[g], lang[g], bucket[g]] = n[g]
    seen[lang[~g], bucket[~g]] = n[~g]
    return Model(languages, grams, seen)


def _labelled(docs: DataFrame, model: Model | None, schema, names: list[str], rows, own: int = 1) -> DataFrame:
    """``rows(found, languages)`` behind the first ``own`` columns of ``docs``, which has a ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)               # a fixed number of values a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value is not None else None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                found = labeller.label(texts) if labeller else [(np.empty(0, np.int64),) * 2 for _ in texts]
                cols = rows(found, labeller.model.languages if labeller else [])
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *cols], names=names)

    return docs.mapInArrow(run, schema)


def _documents(found, languages: list[str]) -> list[pa.Array]:
    lang, score = [], []
    for labels, count in found:
        weight = np.bincount(labels, count, len(languages)) if len(labels) else np.zeros(1)
        total = weight.sum()
        lang.append(languages[int(weight.argmax())] if total else UNKNOWN)
        score.append(float(weight.max() / total) if total else 0.0)
    return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    d = documents(docs)
    d = d.select(d["doc_id"].cast("long").alias("doc_id"), "text")
    return _labelled(d, model, "doc_id long, lang_pred string, score double", ["doc_id", "lang_pred", "score"], _documents)


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` (doc_id first) with lang_pred and lang_score behind them,
    in place of any columns of its own of these names."""
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double")
    own = len(docs.columns)
    return _labelled(docs, model, schema, schema.fieldNames(), _documents, own)


def _spans(found, languages: list[str]) -> list[pa.Array]:
    out = []
    for labels, _ in found:
        start = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]])) if len(labels) else np.empty(0, np.int64)
        out.append([{"start": int(a), "end": int(b), "lang": languages[labels[a]]} for a, b in zip(start, np.append(start[1:], len(labels)), strict=False)])
    return [pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))]


def spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and ``spans``: runs of words (start, end, lang) with one label, whole text."""
    d = documents(docs)
    d = d.select(d["doc_id"].cast("long").alias("doc_id"), "text")
    return _labelled(d, model, "doc_id long, spans array<struct<start: long, end: long, lang: string>>", ["doc_id", "spans"], _spans)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
