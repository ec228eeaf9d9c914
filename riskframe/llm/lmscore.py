"""Cross-entropy difference of a target and a background n-gram model.

Both models share one vocabulary (the code points of the corpus), one order and
one smoothing, and the background's counts are scaled to the target's number of
tokens, so they differ in what they were trained on alone.  Grams are counted
over every whole text, each gram by itself: the tables of counts and of losses
grow with the corpus and are never gathered on one machine.  A document's score
is its mean loss per token under the target model less that under the
background model: lower is closer to the target.

A token's loss depends on its gram of the highest order alone.  Texts are packed
into blocks once, and each block's distinct grams are counted in it (the map-side
sum); the counts are summed over the blocks, the losses are joined from the
counts of the gram's parts, and each block gets back the losses of its own
distinct grams.  So a frequent gram has one row a block, not one a token.

Defined results: a null or empty text has no token and null losses and score;
without target documents the target model is uniform; repeated rows count each
time; a null doc_id is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, gram_buckets, slices, written

SLICE = 4 << 20
BLOCK = 16 << 20                    # bytes of text of a block; a longer single text is a block by itself
PIECE = 1 << 21                     # code points handled at a time; a longer text goes on with its context
KEY = 64                            # bits of a gram's key


def _pieces(texts: list[str | None], order: int):
    """(codes, sizes, rows): texts laid end to end, each behind its context.

    A text starts behind ``order - 1`` codes 0; a piece of a long one behind
    the codes before it.  Only the codes after a sequence's context are tokens.
    """
    codes, sizes, rows, total = [], [], [], 0
    for row, text in enumerate(texts):
        x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([np.zeros(order - 1, np.uint32), x + np.uint32(1)])
        for at in range(order - 1, len(x), PIECE):
            part = x[at - order + 1:at + PIECE]
            codes.append(part)
            sizes.append(len(part))
            rows.append(row)
            total += len(part)
            if total >= PIECE:
                yield np.concatenate(codes), np.array(sizes), np.array(rows)
                codes, sizes, rows, total = [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.array(sizes), np.array(rows)


def _tokens(sizes: np.ndarray, order: int) -> np.ndarray:
    """Marks the places that are tokens, not context."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.arange(len(begin)) - begin >= order - 1


def _ids(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit key of the gram that ends at each code."""
    return gram_buckets(codes, order, KEY)[-1]


def _summed(ids: np.ndarray, grams: np.ndarray, target: np.ndarray, every: np.ndarray):
    """The same four, once an id, the counts summed."""
    at = np.argsort(ids)
    ids = ids[at]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if not len(first):
        return ids, grams, target, every
    return ids[first], grams[at[first]], np.add.reduceat(target[at], first), np.add.reduceat(every[at], first)


def _counted(texts: list[str | None], wanted: np.ndarray, order: int):
    """Ids, grams (rows of ``order`` codes) and counts of the target's and of all tokens."""
    found = []
    for codes, sizes, rows in _pieces(texts, order):
        at = np.flatnonzero(_tokens(sizes, order))
        mine = np.repeat(wanted[rows], sizes)[at].astype(np.int64)
        # the place of a gram's last code stands for the gram until each is there once
        ids, last, target, every = _summed(_ids(codes, order)[at], at, mine, np.ones(len(at), np.int64))
        found.append((ids, codes[last[:, None] + np.arange(1 - order, 1)], target, every))
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(*map(np.concatenate, zip(*found, strict=True)))


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(docs: DataFrame, target: str, order: int) -> DataFrame:
    """Blocks of documents, written once, so that their numbers stand.

    A row is either a block's packed doc_id and text, or a gram of it: id, codes,
    and how often it ends at a token of the target's and of all documents.
    ``target`` is a boolean column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = ["block", "packed", "id", "gram", "target", "every"]
        kept, total = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, kept, total
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, total = [], 0
            text, wanted = whole.column("text").to_pylist(), np.array(whole.column(target).fill_null(False).to_pylist(), bool)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            row = [[number], [_packed(whole.select(["doc_id", "text"]))], [None], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)
            ids, grams, mine, every = _counted(text, wanted, order)
            raw = pa.Array.from_buffers(pa.binary(4 * order), len(ids), [None, pa.py_buffer(np.ascontiguousarray(grams, "<u4").tobytes())])
            for at in range(0, len(ids), 1 << 16):
                some = slice(at, at + (1 << 16))
                n = len(ids[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.binary()), pa.array(ids[some]), raw[some].cast(pa.binary()),
                                                  pa.array(mine[some]), pa.array(every[some])], names=names)
            number += 1

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                size = part.column("text").nbytes
                if kept and total + size > BLOCK:
                    yield from close()
                kept.append(part)
                total += size
        if kept:
            yield from close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", target)
    return written(rows.mapInArrow(run, "block long, packed binary, id long, gram binary, target long, every long"), "lm-blocks")


def table(grams: DataFrame, order: int, bits: int) -> DataFrame:
    """One row a distinct gram: id, counts, and the keys its loss asks for.

    ``ends[k - 1]`` is the key of its last k codes, ``contexts[k - 1]`` that of
    the k codes before its last; ``start`` marks a text's first token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("gram").to_pylist()), "<u4")
            keys = gram_buckets(codes, order, bits)
            ends = np.stack([x[order - 1::order] for x in keys], axis=1)
            contexts = np.stack([x[order - 2::order][:len(ends)] for x in keys[:-1]], axis=1) if order > 1 else np.zeros((len(ends), 0), np.int64)
            start = ~codes.reshape(-1, order)[:, :-1].any(axis=1) if order > 1 else np.zeros(len(ends), bool)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (ends, contexts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("target"), batch.column("every"), *lists, pa.array(start)],
                                             names=["id", "target", "every", "ends", "contexts", "start"])

    each = grams.groupBy("id").agg(F.first("gram").alias("gram"), F.sum("target").alias("target"), F.sum("every").alias("every"))
    return written(each.mapInArrow(run, "id long, target long, every long, ends array<long>, contexts array<long>, start boolean"), "lm-grams")


def count(grams: DataFrame) -> DataFrame:
    """(k, key, target, every): k-grams of the target's and of all documents, of a ``table``."""
    ends = grams.select(F.posexplode("ends").alias("k", "key"), "target", "every")
    # a text's start is a context as well
    starts = grams.where("start").select(F.posexplode("contexts").alias("k", "key"), "target", "every")
    counts = ends.unionByName(starts).groupBy(F.expr("k + 1").alias("k"), "key").agg(F.sum("target").alias("target"), F.sum("every").alias("every"))
    return written(counts, "lm-counts")


def losses(grams: DataFrame, counts: DataFrame, order: int, weight: float) -> DataFrame:
    """(id, target, background): loss of a token that ends the gram, under both models."""
    size = grams.agg(F.sum("target"), F.sum("every")).first()
    target, every = (float(x or 0) for x in size)
    matched = target / every if target else 1.0                                           # matched in size
    vocabulary = max(1, counts.where("k = 1 and every > 0").count())

    # short parts are those of many grams: their counts are dealt out in copies
    copies = lambda k: F.greatest(F.lit(1), F.expr(f"shiftright(64, 3 * ({k} - 1))"))
    asked = grams.select("id", F.posexplode(F.concat("ends", "contexts")).alias("slot", "key"))
    asked = asked.withColumn("k", F.when(F.col("slot") < order, F.col("slot") + 1).otherwise(F.col("slot") - (order - 1)))
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("id"), copies("k")).cast("int"))
    dealt = counts.withColumn("copy", F.explode(F.sequence(F.lit(0), copies("k") - 1)))
    found = asked.join(dealt.hint("merge"), ["k", "key", "copy"])                         # a shuffle join at every size
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)).otherwise(0)).cast("double")
    found = found.groupBy("id").agg(*(at(i, c).alias(f"{c}{i}") for i in range(2 * order - 1) for c in ("target", "every")))
    # lists of (part's count, its context's count) by order, folded to the interpolated probability
    out = []
    for c, scale, n in (("target", 1.0, target), ("every", matched, every * matched)):
        seen = [F.lit(n), *(F.col(f"{c}{order + k}") * scale for k in range(order - 1))]
        pairs = F.array(*(F.struct((F.col(f"{c}{k}") * scale).alias("n"), seen[k].alias("seen")) for k in range(order)))
        p = F.aggregate(pairs, F.lit(1.0 / vocabulary), lambda p, x: (x["n"] + F.lit(weight) * p) / (x["seen"] + F.lit(weight)))
        out.append(-F.log(p))
    return found.select("id", out[0].alias("target"), out[1].alias("background"))


def score(rows: DataFrame, loss: DataFrame, order: int) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (means per token), score (their
    difference) of the documents of ``blocks``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, each = right.column("id").to_numpy(), np.stack([right.column(c).to_numpy() for c in ("target", "background")])
        at = np.argsort(ids)
        ids, each = ids[at], each[:, at]
        out = []
        for raw in left.column("packed"):
            for batch in pa.ipc.open_stream(raw.as_buffer()):
                for part in slices(batch, "text", SLICE):
                    n, total = np.zeros(part.num_rows, np.int64), np.zeros((2, part.num_rows))
                    for codes, sizes, row in _pieces(part.column("text").to_pylist(), order):
                        token = _tokens(sizes, order)
                        place = np.searchsorted(ids, _ids(codes, order)[token])
                        begin = np.cumsum(sizes) - sizes
                        np.add.at(n, row, np.add.reduceat(token.astype(np.int64), begin))
                        for side in range(2):
                            own = np.zeros(len(codes))
                            own[token] = each[side, place]
                            np.add.at(total[side], row, np.add.reduceat(own, begin))
                    a, b = total / np.maximum(n, 1)
                    out.append(pa.table([part.column("doc_id"), pa.array(n), *(pa.array(x, mask=n == 0) for x in (a, b, a - b))],
                                        names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"]))
        return pa.concat_tables(out)

    packed = rows.where("packed is not null").select("block", "packed")
    own = rows.where("id is not null").select("block", "id").join(loss.hint("merge"), "id").select(F.col("block").alias("of"), "id", "target", "background")
    return packed.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(
        run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, order: int = 4, bits: int = KEY, weight: float = 2.0) -> DataFrame:
    """Scores of all of ``docs``; ``target_ids`` (column doc_id) names the target's documents.

    ``bits`` is the width of the key that a gram is counted under; with fewer
    than 64, different grams share counts."""
    wanted = target_ids.select(target_ids["doc_id"].alias("doc_id"), F.lit(True).alias("__target")).where("doc_id is not null").distinct()
    # a shuffle join at every size: the ids grow with the corpus
    marked = documents(docs).join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "text", "__target")
    rows = blocks(marked, "__target", order)
    grams = table(rows.where("id is not null").select("id", "gram", "target", "every"), order, bits)
    return score(rows, losses(grams, count(grams), order, weight), order)
