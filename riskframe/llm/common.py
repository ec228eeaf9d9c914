"""Helpers shared by the operators of this package.

Every operator selects the columns it needs first, so extra columns of the
input, whatever their names, never clash with internal ones.  Internal columns
start with two underscores.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"          # [\x20\x09-\x0D]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators use, as ``doc_id`` and ``text``."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def row_key(docs: DataFrame) -> DataFrame:
    """Add ``__k1``, ``__k2``: a 128-bit key of (doc_id, text).

    Never null and the same in every recomputation.  Rows with a null or
    repeated doc_id keep apart by their text; rows equal in both columns share
    a key and get the same decision.
    """
    return docs.withColumns({"__k1": F.xxhash64(F.lit(1), "doc_id", "text"),
                             "__k2": F.xxhash64(F.lit(2), "doc_id", "text")})


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage: later stages, and retries after a lost executor, read the
    files instead of replaying the plan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small frame, computed once."""
    checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``budget`` bytes.

    A longer single text is a slice by itself, whole.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


class Memo(dict):
    """A bounded cache of a pure function of many keys at once.

    ``fill(words)`` computes what is missing in one call; all of ``words`` can be
    looked up until the next call.  There are two generations: where the young
    one would pass half of ``limit`` it becomes the old one, from which only what
    is asked for again returns.  ``seed`` entries stay.
    """

    def __init__(self, fn, limit: int = 1 << 19, seed: dict | None = None):
        super().__init__(seed or {})
        self.fn, self.limit, self.seed, self.old = fn, limit, dict(seed or {}), {}

    def fill(self, words: Iterable) -> None:
        words = set(words)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.limit // 2 + len(self.seed) and len(self) > len(self.seed):
            self.old = dict(self)
            self.clear()
            self.update(self.seed)
            new = [w for w in words if w not in self]
        if self.old:
            self.update((w, self.old[w]) for w in new if w in self.old)
            new = [w for w in new if w not in self]
        self.update(zip(new, self.fn(new), strict=True))


def spaced_parts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts (null: empty) cut at every space: the number of each part among the distinct
    parts, how many parts each text has (one at least), and the distinct parts."""
    lists = pc.split_pattern(text.cast(pa.large_string()).fill_null(""), " ")
    flat = pc.list_flatten(lists).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64), flat.dictionary


#: Latin letters up to U+017F, but U+0130, whose lower case is two code points.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"


def words_and_marks(parts: pa.Array, marks: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which parts are Latin letters with nothing but ``marks`` behind them, and of those the letters and the marks."""
    simple = pc.match_substring_regex(parts, f"^[{LATIN}]+[{re.escape(marks)}]*$")
    parts = parts.filter(simple)
    return simple.to_numpy(zero_copy_only=False).astype(bool), pc.utf8_rtrim(parts, marks), pc.replace_substring_regex(parts, f"^[{LATIN}]+", "")


def looked_up(cache: Memo, keys: pa.Array) -> list[bytes]:
    """The cache's value of each key, each distinct one looked up once."""
    keys = keys.dictionary_encode()
    distinct = strings(keys.dictionary)
    cache.fill(distinct)
    values = [cache[k] for k in distinct]
    return [values[i] for i in keys.indices.to_numpy().tolist()]


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def gathered(values: list[bytes], which: np.ndarray, counts: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The items (of dtype ``kind``) of ``values[which]`` in one run, and where each text of ``counts`` values ends."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    starts = np.cumsum(size) - size
    n = size[which]
    ends = np.cumsum(n)
    where = np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return np.frombuffer(b"".join(values), kind)[where], np.concatenate([[0], ends])[np.cumsum(counts)]


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a row: the items of ``data`` up to each of ``ends``."""
    data = np.ascontiguousarray(data)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def fresh_names(docs: DataFrame, *values: Column) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns called c0, c1, ... and ``values`` (over its own names) v0, v1, ... behind
    them, so that no name of the input can clash; and the columns under their own names again."""
    df = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], *[v.alias(f"v{i}") for i, v in enumerate(values)])
    return df, [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def key_columns(docs: DataFrame) -> list[Column]:
    """The two halves of ``row_key`` over a frame's own doc_id and text."""
    return [F.xxhash64(F.lit(i), docs["doc_id"], docs["text"]) for i in (1, 2)]


STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_buckets(codes: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For k = 1 .. order, the bucket (of 2**bits) of the k-gram that ends at each code."""
    codes, out = codes.astype(np.uint64) + np.uint64(1), []
    sums, power = np.zeros(len(codes), np.uint64), np.uint64(1)
    for k in range(order):
        sums[k:] += codes[:len(codes) - k] * power
        power = np.uint64(int(power) * int(STEP) & (1 << 64) - 1)
        out.append((spread(sums + np.uint64(k << 56)) >> np.uint64(64 - bits)).astype(np.int64))
    return out
