"""SimHash near-duplicates by an inverted index over byte positions.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints at ``d``
differing bits share at least ``8 - d`` of them.  The index lists fingerprints
under small sets of positional bytes chosen so that every choice of that many
shared positions contains one of the sets; within a list the shared positional
bytes of two fingerprints are tallied, those that reach the guaranteed minimum
are kept, and the bit distance verifies them.  Equal fingerprints are one entry
of the index, so copies are never paired; a list gives a spanning forest of its
links, not all pairs.

Defined results: words are split at [\\x20\\x09-\\x0D]; a text with fewer words
than a shingle has one shingle; a null, empty or blank text has fingerprint
zero and is linked like any other; a null doc_id keeps its row and is never a
component id unless the whole component has none; repeated rows stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fresh_names, key_columns, row_key, shuffle_width, slices, written
from .components import components

SLICE = 4 << 20
CHUNK = 1 << 16                # shingles hashed at a time
LONG_LIST = 1 << 16            # a longer list is dealt anew by one more byte, then by nibbles
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the XXH64 (seed 42) values of a text's word shingles."""
    words = (text or "").encode().lower().split()       # on bytes both are ASCII operations
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    h, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros((8, 8), np.int64)                    # byte, bit from the most significant
    for at in range(0, n, CHUNK):
        a, b = starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist()
        x = np.fromiter([h(joined[i:j], 42) for i, j in zip(a, b, strict=True)], np.uint64, len(a)).astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(x[:, k], minlength=256) @ BITS
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, k1, k2 (the row's key) and ``fp``, the fingerprint as a signed long."""
    d = row_key(documents(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(fp.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    d = d.select(d["doc_id"].cast("long").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text")
    return d.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def cover(matches: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` of 8 positions such that any ``matches`` positions contain one."""
    left = set(itertools.combinations(range(8), matches))
    sets = list(itertools.combinations(range(8), width))
    chosen = []
    while left:
        best = max(sets, key=lambda s: (sum(set(s) <= set(x) for x in left), -len(set(s) & {p for c in chosen[-3:] for p in c})))
        chosen.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return sorted(chosen)


def _byte(fp, position: int):
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255))


def _forest(x: np.ndarray, max_bits: int, matches: int) -> tuple[list, list]:
    """Links that span each linked group of one list's fingerprints."""
    a, b, rest = [], [], x
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        root = queue[0]
        while queue and len(rest):
            near = _linked(rest, queue.pop(), max_bits, matches)
            if near.any():
                new = rest[near]
                a += [root] * len(new)
                b += new.tolist()
                queue += new.tolist()
                rest = rest[~near]
    return a, b


def _linked(x: np.ndarray, y, max_bits: int, matches: int) -> np.ndarray:
    diff = x ^ y
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)       # tally of positional bytes
    return (shared >= matches) & (np.bitwise_count(diff) <= max_bits)


def _links(max_bits: int, matches: int, limit: int | None):
    """Links within the lists of a sorted partition; lists over ``limit`` are handed on
    (kind 1: the fingerprint as ``a``, what its list says of ``free`` nibbles as ``b``)."""

    def batched(kind, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), pa.array([key] * len(a), pa.int64()), pa.array(a), pa.array(b)],
                                          names=["kind", "key", "a", "b"])

    def linked(a, b):
        return batched(0, 0, np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64))

    def on(key, fp, free):
        return batched(1, key, fp.view(np.int64), free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, free, passing = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                k = batch.column("key").to_numpy(zero_copy_only=False)
                f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                r = batch.column("free").to_numpy(zero_copy_only=False)
                if passing is not None:                  # the rest of a long list
                    more = k == passing
                    if more.any():
                        yield on(passing, f[more], r[more])
                        k, f, r = k[~more], f[~more], r[~more]
                    if len(k):
                        passing = None
                key, fp, free = np.concatenate([key, k]), np.concatenate([fp, f]), np.concatenate([free, r])
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            done = len(starts) if batch is None else len(starts) - 1
            sizes = (ends - starts)[:done]
            a, b = [], []
            two = starts[:done][sizes == 2]              # most lists with links hold two
            if len(two):
                near = _linked(np.ascontiguousarray(fp[two]), fp[two + 1], max_bits, matches)
                a += fp[two][near].tolist()
                b += fp[two + 1][near].tolist()
            for i in np.flatnonzero(sizes > 2):
                x, y = _forest(fp[starts[i]:ends[i]], max_bits, matches)
                a += x
                b += y
            if a:
                yield linked(a, b)
            if batch is not None:
                key, fp, free = key[starts[-1]:], fp[starts[-1]:], free[starts[-1]:]
                if limit is not None and len(key) > limit:
                    passing = int(key[0])
                    yield on(passing, fp, free)
                    key, fp, free = key[:0], fp[:0], free[:0]

    return run


#: A long list again, under each further byte that its pairs may share.  ``free`` has a bit for each nibble (from
#: the most significant) that the list's key doesn't hold.  Keys are hashed: lists that happen to meet only add comparisons.
BYTE_ROUND = """transform(filter(sequence(0, 7), p -> (shiftright(free, 2 * p) & 1) = 1), p ->
    struct(xxhash64(key, p, shiftrightunsigned(fp, 56 - 8 * p) & 255) AS key, free & ~shiftleft(3L, 2 * p) AS free))"""


def _nibble_round(max_bits: int) -> str:
    """And again under single nibbles: differing bits spoil ``max_bits`` of the free ones at most, so of any
    ``max_bits + 1`` one is shared.  When ``max_bits`` are free a list holds 16 ** max_bits values at most."""
    return f"""transform(slice(filter(sequence(0, 15), p -> (shiftright(free, p) & 1) = 1), 1, {max_bits + 1}), p ->
        struct(xxhash64(key, p, 16L, shiftrightunsigned(fp, 60 - 4 * p) & 15) AS key, free & ~shiftleft(1L, p) AS free))"""


def links(fps: DataFrame, max_bits: int = 4, key_bytes: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every group of
    fingerprints joined by pairs at ``max_bits`` or fewer differing bits."""
    matches = 8 - max_bits
    if matches < 1:
        raise ValueError("at 8 or more bits no positional byte need be shared")
    sets = cover(matches, key_bytes or max(1, matches - 1))
    fp, width = F.col("fp"), shuffle_width(fps.sparkSession)
    fixed = len(sets[0])
    wide = fixed < matches                               # one more byte must be shared
    nibbles = 16 - 2 * (fixed + wide)
    rounds = [BYTE_ROUND] * wide + [_nibble_round(max_bits)] * max(0, nibbles - max_bits)

    def listed(df: DataFrame, limit: int | None) -> DataFrame:
        return written(df.repartition(width, "key").sortWithinPartitions("key", "fp")
                       .mapInArrow(_links(max_bits, matches, limit), "kind int, key long, a long, b long"), "simhash-links")

    keys = []
    for i, s in enumerate(sets):
        key, free = F.lit(i).cast("long"), sum(1 << n for n in range(16) if n // 2 not in s)
        for p in s:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        keys.append(F.struct(key.alias("key"), F.lit(free).cast("long").alias("free")))
    lists = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    direct = None
    for left in range(len(rounds), -1, -1):
        found = listed(lists, LONG_LIST if left else None)
        own = found.where("kind = 0").select("a", "b")
        direct = own if direct is None else direct.unionByName(own)
        handed = found.where("kind = 1").select("key", F.col("a").alias("fp"), F.col("b").alias("free"))
        if not left or handed.isEmpty():
            return direct
        deal = rounds[len(rounds) - left]
        lists = handed.select("fp", F.explode(F.expr(deal)).alias("k")).select("fp", "k.*")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable
    over links) of every row; also its key (k1, k2) and ``group``, never null, of its component."""
    each = written(fingerprints(docs, shingle), "simhash-fp")
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(links(distinct.select("fp"), max_bits), "a", "b")
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    label = member.select("fp", "root").join(named, "root").select("fp", "component_id", F.col("root").alias("group"))
    return each.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "k1", "k2", "group")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each near-duplicate group, that of its smallest doc_id (a null id last); ``docs``'s columns."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("one"))
    first = first.select(F.col("one.k1").alias("v0"), F.col("one.k2").alias("v1"))
    d, own = fresh_names(docs, *key_columns(docs))
    w = Window.partitionBy("v0", "v1").orderBy(*[f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")] or ["v0"])
    return d.join(first, ["v0", "v1"]).withColumn("n", F.row_number().over(w)).where("n = 1").select(own)      # equal rows: one
