"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands.

Repetitive text compresses far better than prose, keys and encoded data hardly
at all; but the ratio (compressed by plain bytes) also falls with the length.
Whole documents are therefore held against limits of their length's band, and
fixed chunks of longer ones against limits of their own, so a long document is
also rejected if too large a share of it is junk.  Chunks cover every byte; a
rest under half a chunk belongs to the chunk before it.

Map-only: texts pass in slices, a long one whole; words and lines of a slice
are dictionary-encoded by Arrow and counted by numpy.  The verdict is a column
expression over the counts.  Defined results: a null text has no word; texts
without bytes have no ratio and are in every band; repeated rows give repeated
results; a null doc_id is passed on; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

SLICE = 2 << 20
LEVEL = 3
CHUNK = 4096
#: (bytes below which it holds, least ratio, greatest ratio): prose of 200 bytes has 0.5 to 0.9,
#: of 4 KB 0.4 to 0.6, of 50 KB 0.3 to 0.5; a phrase said over and over under 0.1; base64 0.75 and more.
BANDS = ((256, 0.30, 9.0), (512, 0.25, 0.90), (1024, 0.22, 0.80), (4096, 0.18, 0.75), (16384, 0.15, 0.70), (1 << 62, 0.12, 0.66))
CHUNK_LIMITS = (0.15, 0.72)
#: Of 100 chunks, how many may lie outside their limits.
BAD_CHUNKS = 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
INNER = np.zeros(256, bool)            # UTF-8 bytes that begin no code point
INNER[0x80:0xC0] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_compressed", "n_chunks", "n_bad_chunks"]


def _ids(parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = parts.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _named(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row of ``columns`` among the distinct rows, and how often each occurs."""
    name = columns[0]
    for c in columns[1:]:
        name = np.unique(name, return_inverse=True)[1] * (int(c.max(initial=0)) + 1) + c
    _, name, n = np.unique(name, return_inverse=True, return_counts=True)
    return name, n


def _bytes(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one run, and where each text ends."""
    _, offsets, values = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[at[0]:at[-1]], at[1:] - at[0]


def word_counts(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and of those how many lie in a window of three that occurs again in it."""
    cut = pc.ascii_split_whitespace(raw.view(pa.large_string()))       # [\x20\x09-\x0D]+
    doc, part = pc.list_parent_indices(cut), pc.list_flatten(cut)
    whole = pc.greater(pc.binary_length(part), 0)
    doc = doc.filter(whole).to_numpy().astype(np.int64)
    word, _ = _ids(part.filter(whole))
    n = len(raw)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    name, times = _named(word[at], word[at + 1], word[at + 2], doc[at])
    again = np.zeros(len(word), bool)
    hit = at[times[name] > 1]
    for i in range(3):
        again[hit + i] = True
    return np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n)


def repeated_lines(raw: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier one."""
    cut = pc.split_pattern(raw, b"\n")
    doc = pc.list_parent_indices(cut).to_numpy().astype(np.int64)
    line, lines = _ids(pc.list_flatten(cut))
    worded = pc.match_substring_regex(lines, rb"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    keep = worded[line] if len(line) else np.zeros(0, bool)
    doc, line = doc[keep], line[keep]
    distinct = np.unique(doc * (len(lines) + 1) + line) // (len(lines) + 1)
    return np.bincount(doc, minlength=len(raw)) - np.bincount(distinct, minlength=len(raw))


@functools.lru_cache(maxsize=2)
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def compressed_sizes(text: np.ndarray, level: int, chunk: int, limits: tuple[float, float]) -> tuple[int, int, int]:
    """Compressed bytes of the whole text; number of its chunks, and of those outside ``limits`` (0, 0 if it is one chunk)."""
    size, n = lambda x: len(compressor(level).compress(x)), len(text)
    n_chunks = max(1, (n + chunk // 2) // chunk)
    whole = size(text) if n else 0
    if n_chunks == 1:
        return whole, 0, 0
    ends = [chunk * i for i in range(1, n_chunks)] + [n]
    bad = sum(not limits[0] <= size(text[a:b]) / (b - a) <= limits[1] for a, b in zip([0, *ends], ends, strict=False))
    return whole, n_chunks, bad


def measure(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK, chunk_limits: tuple[float, float] = CHUNK_LIMITS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text: n_words, word_chars (code points in
    words), n_symbols, n_dup_lines, n_repeat_words, n_bytes, n_compressed, n_chunks, n_bad_chunks."""
    d = documents(docs, id_col, text_col)
    d = d.select(d["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw = part.column("text").cast(pa.large_string()).view(pa.large_binary())
                data, ends = _bytes(raw)
                sizes = np.diff(ends, prepend=0)

                def per_text(of_byte: np.ndarray, ends=ends, sizes=sizes) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(of_byte, dtype=np.int64)])
                    return total[ends] - total[ends - sizes]

                n_words, n_repeat = word_counts(raw)
                zipped = np.array([compressed_sizes(data[e - s:e], level, chunk, chunk_limits) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], np.int64).reshape(-1, 3)
                cols = [n_words, sizes - per_text(BLANK[data] | INNER[data]), per_text(SYMBOL[data]), repeated_lines(raw), n_repeat, sizes, *zipped.T]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in cols)], names=["doc_id", *COUNTS])

    return d.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def in_bands(bands=BANDS, bad_chunks: int = BAD_CHUNKS) -> Column:
    """True if a measured document's ratio lies in its length's band and at most
    ``bad_chunks`` of 100 of its chunks lie outside theirs."""
    ratio = F.col("n_compressed") / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    verdict = None
    for below, low, high in sorted(bands):
        here = ratio.between(low, high)
        fits = F.col("n_bytes") < below
        verdict = F.when(fits, here) if verdict is None else verdict.when(fits, here)
    return F.coalesce(verdict, F.lit(True)) & (100 * F.col("n_bad_chunks") <= bad_chunks * F.col("n_chunks"))


def judge(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, bands=BANDS, bad_chunks: int = BAD_CHUNKS, **measured) -> DataFrame:
    """``measure`` with ratio, base_failed (under ``min_words`` words, or over
    ``max_repeat`` of 100 words in repeated windows), in_bands and kept."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    m = measure(docs, **measured)
    m = m.withColumns({"ratio": F.col("n_compressed") / F.when(F.col("n_bytes") > 0, F.col("n_bytes")),
                       "base_failed": base, "in_bands": in_bands(bands, bad_chunks)})
    return m.withColumn("kept", ~F.col("base_failed") & F.col("in_bands"))
