"""Repeated passages by restricted recompression of word sequences.

Words are symbols.  Rounds alternately name maximal runs of one symbol and
pairs of a left and a right symbol (a symbol's side in a round is a bit of its
name), on symbols of at most a round's length.  A name is a hash of what it
stands for, so it is the same in every document and task.  Whether a phrase
boundary survives all rounds depends on ``context`` words on either side only,
so equal windows of words have equal boundaries, and equal symbols, inside.

Each window is filed under one interior boundary, that with the least name of
its surrounding words; windows without one are filed under their own name.  A
document so gives a few anchors, each with a run of windows.  Spark counts the
anchors' names: a name met once holds no repeat; where all its occurrences have
the same whole span, all their windows repeat; the windows of the rest are
verified one by one by 128-bit names.

Nothing is gathered per passage: names are counted with map-side sums, and the
joins that return them to documents are split by the adaptive skew join.

Defined results: words are split at [\\x20\\x09-\\x0D] and compared unchanged; a
null or empty text has no word; a text shorter than a window keeps all; rows
are documents of their own, so a repeated row repeats the other's windows; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, row_key, slices, spread, written

ROUNDS = (1, 1, 2, 2)                # longest symbol that a round joins: run, pair, run, pair
CONTEXT = sum(ROUNDS)
PIECE = 1 << 17                      # words handled at a time; pieces of a document overlap by a window
SLICE = 2 << 20
U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))       # odd multipliers of the two rolling names


class Names:
    """64-bit names of ranges of a symbol sequence, by prefix sums."""

    def __init__(self, x: np.ndarray, base: np.uint64):
        inverse = U(pow(int(base), -1, 1 << 64))
        n = len(x)
        powers = np.cumprod(np.concatenate([[U(1)], np.full(n, base, U)]), dtype=U)
        self.back = np.cumprod(np.concatenate([[U(1)], np.full(n, inverse, U)]), dtype=U)
        self.sums = np.concatenate([[U(0)], np.cumsum(x * powers[:n], dtype=U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spread((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def word_names(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    h = xxhash.xxh3_64_intdigest
    return np.fromiter([h(w) for w in words], U, len(words))


def boundaries(x: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Positions where a phrase starts after all rounds; ``fresh`` marks a sequence's first word."""
    start, name = np.arange(len(x)), x
    for number, longest in enumerate(ROUNDS):
        size = np.diff(np.append(start, len(x)))
        active = size <= longest
        both = active[1:] & active[:-1] & ~fresh[start[1:]]
        if number % 2 == 0:                              # runs
            joined = both & (name[1:] == name[:-1])
        else:                                            # pairs
            side = (spread(name + U(number)) & U(1)).astype(bool)
            joined = both & ~side[:-1] & side[1:]
        keep = np.concatenate([[True], ~joined])
        first = np.flatnonzero(keep)
        count = np.diff(np.append(first, len(name)))
        if number % 2 == 0:
            name = np.where(count > 1, spread(name[first] * U(3) + count.astype(U) + U(number << 32)), name[first])
        else:
            name = np.where(count > 1, spread(name[first] * U(5) + spread(name[np.minimum(first + 1, len(name) - 1)]) + U(number << 32)), name[first])
        start = start[first]
    return start


def anchors(x: np.ndarray, sizes: np.ndarray, width: int):
    """(sequence, name, span, first, count) of every run of windows filed under one boundary.

    ``x`` holds sequences of ``sizes`` words end to end; ``first`` is the run's
    first window in its sequence, ``span`` names all its words and their place.
    """
    n = len(x)
    if not n:
        return (np.empty(0, np.int64),) * 5
    ends = np.cumsum(sizes)
    begins = ends - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    fresh = np.zeros(n, bool)
    fresh[begins[sizes > 0]] = True
    one, two = Names(x, BASES[0]), Names(x, BASES[1])

    # the least name among the interior boundaries of every window
    at = boundaries(x, fresh)
    at = at[(at - CONTEXT >= begins[of[at]]) & (at + CONTEXT <= ends[of[at]])]
    rank = np.full(n + 1, NONE, U)
    rank[at] = one.of(at - CONTEXT, at + CONTEXT)
    reach = width - 2 * CONTEXT + 1                      # interior positions of a window
    best, where, have = rank, np.arange(n + 1), 1
    while have < reach:
        step = min(have, reach - have)
        a, b = best[:-step], best[step:]
        right = b < a
        where = np.where(right, where[step:], where[:-step])
        best = np.where(right, b, a)
        have += step
    s = np.flatnonzero(np.arange(n) + width <= ends[of])
    if not len(s):
        return (np.empty(0, np.int64),) * 5
    place, name = where[s + CONTEXT], best[s + CONTEXT]
    bare = name == NONE
    place = np.where(bare, -1 - s, place)                # filed alone
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (of[s][1:] != of[s][:-1])])
    lo = np.flatnonzero(new)
    count = np.diff(np.append(lo, len(s)))
    first, last = s[lo], s[lo] + count - 1
    name = np.where(bare[lo], spread(one.of(first, first + width) + U(1)), name[lo])
    span = spread(two.of(first, last + width) + np.where(bare[lo], 0, place[lo] - first).astype(U) * U(977) + count.astype(U))
    seq = of[first]
    return seq, name.view(np.int64), span.view(np.int64), first - begins[seq], count


def _pieces(names: list[np.ndarray], width: int):
    """Sequences of bounded length: (row, offset, names); long rows in pieces that share ``width - 1`` words."""
    for row, x in enumerate(names):
        for at in range(0, max(1, len(x) - width + 1), PIECE):
            yield row, at, x[at:at + PIECE + width - 1]


def _grouped(pieces, limit: int):
    held, total = [], 0
    for p in pieces:
        held.append(p)
        total += len(p[2])
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def anchor_rows(keyed: DataFrame, width: int) -> DataFrame:
    """name, span, k1, k2, first, count of all documents' anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                k1, k2 = (part.column(c).to_numpy() for c in ("__k1", "__k2"))
                names = [word_names(t) for t in part.column("text").to_pylist()]
                for group in _grouped(_pieces(names, width), 4 * PIECE):
                    row, off = np.array([p[0] for p in group]), np.array([p[1] for p in group])
                    seq, name, span, first, count = anchors(np.concatenate([p[2] for p in group]), np.array([len(p[2]) for p in group]), width)
                    cols = [name, span, k1[row[seq]], k2[row[seq]], off[seq] + first, count]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["name", "span", "k1", "k2", "first", "count"])

    return keyed.select("__k1", "__k2", "text").mapInArrow(run, "name long, span long, k1 long, k2 long, first long, count long")


def _window_rows(width: int):
    """128-bit names of the windows that ``runs`` asks for, with their place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = []
                for k1, k2, text, runs in zip(*(part.column(c).to_pylist() for c in ("__k1", "__k2", "text", "runs")), strict=True):
                    x = word_names(text)
                    want = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs]))
                    for at in range(0, len(x) - width + 1, PIECE):
                        s = want[np.searchsorted(want, at):np.searchsorted(want, at + PIECE)] - at
                        if len(s):
                            piece = x[at:at + PIECE + width - 1]
                            d = [Names(piece, b).of(s, s + width).view(np.int64) for b in BASES]
                            out.append([*d, np.full(len(s), k1), np.full(len(s), k2), s + at])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["d1", "d2", "k1", "k2", "first"])
    return run


def repeated_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """k1, k2 (the document's key), first, count: runs of windows whose words also start elsewhere."""
    if width < 2 * CONTEXT:
        raise ValueError(f"a window needs at least {2 * CONTEXT} words")
    keyed = row_key(documents(docs))
    rows = anchor_rows(keyed, width)
    shared = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("span").alias("a"), F.max("span").alias("b"))
    shared = written(shared.where("n > 1").select("name", (F.col("a") == F.col("b")).alias("whole")), "repeat-names")
    found = written(rows.join(shared, "name").select("k1", "k2", "first", "count", "whole"), "repeat-anchors")

    # the same exchange of texts serves the final join of `cut_repeats`
    runs = found.where("not whole").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    texts = keyed.join(runs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "runs"), ["__k1", "__k2"])
    windows = texts.select("__k1", "__k2", "text", "runs").mapInArrow(_window_rows(width), "d1 long, d2 long, k1 long, k2 long, first long")
    windows = written(windows, "repeat-windows")
    twice = windows.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    verified = windows.join(twice, ["d1", "d2"]).select("k1", "k2", "first", F.lit(1).cast("long").alias("count"))
    return found.where("whole").select("k1", "k2", "first", "count").unionByName(verified)


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                kept, total, gone = [], [], []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in runs or ():
                        edge[r["first"]] += 1
                        edge[min(r["first"] + r["count"] - 1 + width, len(words))] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    total.append(len(words))
                    gone.append(int(len(words) - keep.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)] if gone[-1] else words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                                 names=["doc_id", "text", "n_words", "n_removed"])
    return run


def cut_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, text (words outside every repeated window, joined by one space), n_words, n_removed."""
    keyed = row_key(documents(docs))
    runs = repeated_windows(docs, width).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "count")).alias("runs"))
    runs = runs.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "runs")
    rows = keyed.join(runs, ["__k1", "__k2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return rows.mapInArrow(_cut(width), "doc_id long, text string, n_words long, n_removed long")
