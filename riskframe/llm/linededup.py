"""Line deduplication by a range-partitioned, sorted stream of line hashes.

Every line's 128-bit hash goes, with its document and position, to a range of
the hash order; a secondary sort by document and position lets one pass over
each range see first occurrences and count documents without holding a run.
A run that a range boundary cuts is settled from one summary row per fragment,
so a line that a third of the rows share is spread over many tasks.  Documents
get a compressed bitmap of kept lines; texts are not carried along.

Defined results: a null or empty text is one empty line; a document is a
distinct (doc_id, text), so rows equal in both get the same bitmap and count
once; a null doc_id is a value like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, ascii_lower, documents, fresh_names, key_columns, row_key, shuffle_width, slices, written

SLICE = 4 << 20
DECIDED, PENDING, SUMMARY = 0, 1, 2
FIELDS = ["h1", "h2", "doc_id", "k1", "k2", "pos"]
STREAM = "kind int, " + ", ".join(f"{c} long" for c in FIELDS) + ", seq long, n_docs long, l1 long, l2 long"
OUT = ["kind", *FIELDS, "seq", "n_docs", "l1", "l2"]


def line_array(text):
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, k1, k2, pos of every line whose key has ``min_chars`` code points."""
    d = row_key(documents(docs)).select("doc_id", "__k1", "__k2", F.posexplode(line_array(ascii_lower(F.col("text")))).alias("pos", "line"))
    key = F.btrim("line", F.lit(WHITE))
    d = d.select("doc_id", "__k1", "__k2", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return d.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"),
                    F.col("doc_id").cast("long").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"),
                    F.col("pos").cast("long").alias("pos"))


def _stream(min_docs: int, keep_first: bool):
    """One pass over a sorted range: dropped rows, and what its two ends leave open."""

    def rows(kind, x: np.ndarray, seq=None, n_docs=None, last=None, null=None) -> pa.RecordBatch:
        n = x.shape[1]
        cols = [pa.array(np.full(n, kind, np.int32))]
        for i in range(6):
            cols.append(pa.array(x[i], mask=null if i == 2 and null is not None else None))
        zero = np.zeros(n, np.int64)
        cols += [pa.array(zero if seq is None else seq), pa.array(zero if n_docs is None else np.full(n, n_docs)),
                 *(pa.array(zero if last is None else np.full(n, v)) for v in (last or (0, 0)))]
        return pa.RecordBatch.from_arrays(cols, names=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the run that is open: its hash, first row, documents so far, last document, rows seen
        hash_, first, n_docs, last, seen = None, None, 0, None, 0
        opening = True                                   # still in the range's first run
        before = None
        held: list[np.ndarray] = []                      # undecided rows of the open run: fewer than min_docs documents

        for batch in batches:
            x = np.stack([batch.column(c).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for c in FIELDS]).astype(np.int64)
            if before is not None:                       # a repeated row shows as equal neighbours
                x = np.concatenate([before, x], axis=1)
            fresh = (x[:, 1:] != x[:, :-1]).any(axis=0)
            if before is None:
                fresh = np.concatenate([[True], fresh]) if x.shape[1] else fresh
            else:
                x = x[:, 1:]
            x = x[:, fresh]
            n = x.shape[1]
            if not n:
                continue
            before = x[:, -1:].copy()
            new_run = np.empty(n, bool)
            new_run[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
            new_run[0] = hash_ != (x[0, 0], x[1, 0])
            new_doc = new_run.copy()
            new_doc[1:] |= (x[3, 1:] != x[3, :-1]) | (x[4, 1:] != x[4, :-1])
            new_doc[0] |= last != (x[3, 0], x[4, 0])
            starts = np.flatnonzero(new_run)
            if not new_run[0]:
                starts = np.concatenate([[0], starts])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            ends = np.append(starts[1:], n)
            lo = 0
            if not new_run[0]:                           # the open run goes on
                n_docs += int(docs[0])
                part = x[:, :ends[0]]
                if opening:
                    yield rows(PENDING, part, seen + np.arange(part.shape[1]))
                else:
                    held.append(part)
                    if n_docs >= min_docs:
                        yield from (rows(DECIDED, x_) for x_ in held)
                        held = []
                seen += part.shape[1]
                last = (x[3, ends[0] - 1], x[4, ends[0] - 1])
                lo = 1
            if lo < len(starts):
                if hash_ is not None and opening:        # the first run ends here
                    yield rows(SUMMARY, first, None, n_docs, last)
                opening = hash_ is None
                held = []
                # whole runs inside this batch; the last one stays open, and the range's first is pending
                a = lo + int(opening)
                if opening and len(starts) > lo + 1:
                    part = x[:, starts[lo]:ends[lo]]
                    yield rows(PENDING, part, np.arange(part.shape[1]))
                    yield rows(SUMMARY, part[:, :1], None, int(docs[lo]), (part[3, -1], part[4, -1]))
                    opening = False
                if a < len(starts) - 1:
                    drop = np.repeat(docs[a:-1] >= min_docs, (ends - starts)[a:-1])
                    if keep_first:
                        drop[(starts[a:-1] - starts[a])] = False
                    if drop.any():
                        yield rows(DECIDED, x[:, starts[a]:starts[-1]][:, drop])
                part = x[:, starts[-1]:]
                hash_, first, n_docs, seen = (part[0, 0], part[1, 0]), part[:, :1].copy(), int(docs[-1]), part.shape[1]
                last = (part[3, -1], part[4, -1])
                if opening:
                    yield rows(PENDING, part, np.arange(part.shape[1]))
                else:
                    held = [part[:, int(keep_first):].copy()]
                    if n_docs >= min_docs:
                        yield rows(DECIDED, held[0])
                        held = []
        if hash_ is not None:
            # seq 1 on later rows: the row that opened this run here is no longer first of all if a fragment precedes
            at = int(keep_first)
            for part in held:
                yield rows(PENDING, part, at + np.arange(part.shape[1]))
                at += part.shape[1]
            yield rows(SUMMARY, first, None, n_docs, last)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """k1, k2, pos of each line to drop: lines in at least ``min_docs`` documents,
    but their first occurrence (by doc_id, then position) if ``keep_first``."""
    lines = line_rows(docs, min_chars)
    order = ["h1", "h2", "doc_id", "k1", "k2", "pos"]
    ranged = lines.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    out = written(ranged.mapInArrow(_stream(min_docs, keep_first), STREAM), "line-runs")

    # at most two fragments a range: how many documents share each cut run
    w = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id"), "k1", "k2", "pos")
    ends = out.where(F.col("kind") == SUMMARY).select("h1", "h2", "doc_id", "k1", "k2", "pos", "n_docs", "l1", "l2")
    same = (F.lag("l1").over(w) == F.col("k1")) & (F.lag("l2").over(w) == F.col("k2"))
    ends = ends.withColumn("own", F.col("n_docs") - F.coalesce(same, F.lit(False)).cast("long"))
    first = F.min_by(F.struct("k1", "k2", "pos"), F.struct("doc_id", "k1", "k2", "pos"))
    cut_runs = ends.groupBy("h1", "h2").agg(F.sum("own").alias("__docs"), first.alias("__first"))
    cut_runs = cut_runs.where(F.col("__docs") >= min_docs).select("h1", "h2", "__first")
    pending = out.where(F.col("kind") == PENDING).select("h1", "h2", "k1", "k2", "pos")
    pending = pending.join(F.broadcast(cut_runs), ["h1", "h2"])
    if keep_first:
        pending = pending.where(F.struct("k1", "k2", "pos") != F.col("__first"))
    return (out.where(F.col("kind") == DECIDED).select("k1", "k2", "pos")
            .unionByName(pending.select("k1", "k2", "pos")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, count = [], []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[gone] = 0
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            count.append(len(gone))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("k1", "k2", "n_lines")] + [pa.array(count, pa.int64()), pa.array(keep, pa.binary())],
                                         names=["k1", "k2", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """One row per document (k1, k2: its key): n_lines, n_dropped, and ``keep``, a
    zlib-compressed bitmap with bit i (most significant first) set if line i stays."""
    d = row_key(documents(docs))
    every = d.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.lit(None).cast("int").alias("pos"),
                     F.size(line_array(F.col("text"))).cast("long").alias("n_lines"))
    gone = dropped_lines(docs, min_docs, keep_first, min_chars).select("k1", "k2", F.col("pos").cast("int").alias("pos"), F.lit(None).cast("long").alias("n_lines"))
    # a list is as long as its document's lines at most
    rows = every.unionByName(gone).groupBy("k1", "k2").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return rows.mapInArrow(_pack, "k1 long, k2 long, n_lines long, n_dropped long, keep binary")


def _apply(columns: list[str], text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text, SLICE):
                changed = pc.greater(b.column("n_dropped"), 0)
                some, kept = b.filter(changed), []
                for t, n, keep in zip(*(some.column(c).to_pylist() for c in (text, "n_lines", "keep")), strict=True):
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    lines = t.split("\n")
                    kept.append("\n".join([lines[i] for i in np.flatnonzero(bits)]))
                new = pc.replace_with_mask(b.column(text), changed, pa.array(kept, b.column(text).type))
                yield pa.RecordBatch.from_arrays([new if c == text else b.column(c) for c in columns], names=names)
    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with dropped lines cut from the text, plus n_lines and n_dropped
    in place of any columns of its own of these names (a text without dropped
    lines is left as it is)."""
    docs = docs.drop("n_lines", "n_dropped")
    d, own = fresh_names(docs, *key_columns(docs))
    joined = d.join(bitmaps.select("k1", "k2", "n_lines", "n_dropped", "keep"), (F.col("v0") == F.col("k1")) & (F.col("v1") == F.col("k2")))
    columns = [f"c{i}" for i in range(len(docs.columns))] + ["n_lines", "n_dropped"]
    schema = T.StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_dropped", "long")
    return joined.select(*columns, "keep").mapInArrow(_apply(columns, f"c{docs.columns.index('text')}", schema.fieldNames()), schema)


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """doc_id, text (kept lines joined by a newline), n_lines (before), n_dropped."""
    d = documents(docs)
    return apply_bitmaps(d, keep_bitmaps(d, min_docs, keep_first, min_chars))
