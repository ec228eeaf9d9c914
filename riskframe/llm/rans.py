"""Token ids in binary files coded by a static range asymmetric numeral system.

The whole corpus is tokenised and its ids counted; one shared frequency table
codes every file.  Documents go to ranges of doc_id, one file each, and are cut
into independent blocks of whole documents.  A block interleaves its ids over
``LANES`` coder states; every ``STEPS`` steps it keeps a checkpoint (states,
place in the word stream) and the checksum of the ids up to the next one, so a
reader starts at any checkpoint and blocks decode in parallel.  A file is a
Parquet file of blocks, written by Spark's own committer.

Defined results: documents lie in ascending doc_id order, null first, rows with
one doc_id by their text's hash and repeated rows one after another; a null or
empty text is the end id alone; an empty table gives files without blocks.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import Memo, binary_rows, documents, gathered, looked_up, row_key, shuffle_width, slices, spaced_parts, words_and_marks

BITS = 20                       # frequencies sum to 2**BITS
LANES = 2048
STEPS = 128                     # steps between checkpoints
BLOCK = 1 << 19                 # ids after which a block is closed
SLICE = 4 << 20
JOINED = 4096                   # words encoded as one text
TAIL = ".,!?;:*#$%&|)]}\"-+=/"  # marks that always start a pre-token of their own behind a letter or digit


def plain(word: str) -> bool:
    """Of characters up to Latin Extended-A, whose lower case is one letter each (U+0130's is not)."""
    return word.isascii() or max(word) <= "\u017f" and "\u0130" not in word


class Words:
    """Token ids of texts by the tokenizers library, each distinct word encoded once.

    The vocabulary's texts are cut at white space before anything else, so a
    text's ids are those of its pieces between spaces and line ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = json.loads(self.model.to_str())["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.model.get_vocab_size(), bool)          # ids that end a pre-token
        if suffix:
            self.last[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True
        self.cores = Memo(self._encode, 1 << 19)
        self.parts = Memo(self._split, 1 << 18)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Plain words are one pre-token each: many go in one text, cut behind each
        pre-token's last id.  Others are texts of their own."""
        whole = [w for w in words if w.isalpha() and plain(w)] if self.last.any() else []
        found = {}
        for at in range(0, len(whole), JOINED):
            some = whole[at:at + JOINED]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize
            if len(ends) != len(some):
                continue                                     # not one pre-token each after all
            raw = ids.tobytes()
            found.update(zip(some, [raw[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])], strict=True))
        rest = [w for w in words if w not in found]
        if rest:
            found.update(zip(rest, [np.array(e.ids, self.kind).tobytes() for e in self.model.encode_batch_fast(rest, add_special_tokens=False)], strict=True))
        return [found[w] for w in words]

    def _split(self, parts: list[str]) -> list[bytes]:
        """A word without the marks behind it, in lower case if plain, has the ids it has alone.

        Special tokens are matched in their own case: what may hold one keeps its case."""
        cut = []
        for p in parts:
            core = p.rstrip(TAIL)
            if core and core[-1].isalnum() and plain(core):
                cut.append((core if "<|" in core else core.lower(), p[len(core):]))
            else:
                cut.append((p, ""))
        self.cores.fill(itertools.chain.from_iterable(cut))
        get = self.cores.__getitem__
        return [get(a) + get(b) for a, b in cut]

    def encode_array(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one run, and where each text's end."""
        which, counts, parts = spaced_parts(pc.replace_substring(text, "\n", " "))
        simple, core, tail = words_and_marks(parts, TAIL)
        ids = np.empty(len(parts), object)
        ids[simple] = [a + b for a, b in zip(looked_up(self.cores, pc.utf8_lower(core)), looked_up(self.cores, tail), strict=True)]
        ids[~simple] = looked_up(self.parts, parts.filter(pa.array(~simple)))
        return gathered(ids.tolist(), which, counts, self.kind)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return binary_rows(ids, ends).to_pylist()


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def tokenised(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, k1, k2 (the row's key) and ``ids``, the end id behind each document's."""
    d = row_key(documents(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, ends = w.encode_array(part.column("text"))
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "k1", "k2")] + [binary_rows(ids, ends)], names=["doc_id", "k1", "k2", "ids"])

    return d.mapInArrow(run, "doc_id long, k1 long, k2 long, ids binary")


def frequencies(tokens: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """Counts of every id over all documents, scaled to sum to 2**BITS; an id that
    occurs keeps at least 1.  Gathers one row an id of the vocabulary at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return scaled(counts)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies that sum to 2**BITS, at least 1 for every count above 0."""
    present = counts > 0
    free = (1 << BITS) - int(present.sum())
    if free < 0:
        raise ValueError(f"more than 2**{BITS} different ids")
    if not present.any():
        return counts
    freq = present + np.floor(counts * (free / counts.sum())).astype(np.int64)
    freq[int(counts.argmax())] += (1 << BITS) - int(freq.sum())
    return freq


class Coder:
    """Interleaved coder of one frequency table: 64-bit states, 32-bit words."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.most = self.freq << np.uint64(63 - BITS)                 # a state from here on gives up a word first
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.filler = int(freq.argmax())

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[tuple[int, bytes, int]]]:
        """The word stream, and per checkpoint: place in the stream, states, checksum of its ids."""
        steps = -(-len(ids) // LANES)
        rows = np.full(steps * LANES, self.filler, np.int64)
        rows[:len(ids)] = ids
        rows = rows.reshape(steps, LANES)
        x = np.full(LANES, 1 << 31, np.uint64)
        low, shift, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(BITS)
        chunks, marks, sent = [], [], 0
        for at in range((steps - 1) // STEPS * STEPS, -1, -STEPS) if steps else ():
            part = rows[at:at + STEPS]
            freq, below, most = self.freq[part], self.below[part], self.most[part]
            for t in range(len(part) - 1, -1, -1):
                full = x >= most[t]
                out = x[full]
                chunks.append((out & low).astype("<u4"))
                sent += len(out)
                x[full] = out >> shift
                f = freq[t]
                q = x // f
                x = (q << scale) + (x - q * f) + below[t]
            marks.append((sent, x.astype("<u8").tobytes(), zlib.crc32(ids[at * LANES:(at + STEPS) * LANES].astype("<u4").tobytes())))
        stream = np.concatenate(chunks[::-1]) if chunks else np.empty(0, "<u4")
        return stream.tobytes(), [(sent - s, states, crc) for s, states, crc in marks[::-1]]

    def decode(self, stream: bytes, marks: list, n: int, part: int) -> np.ndarray:
        """The ids from checkpoint ``part`` up to the next one, held against their checksum."""
        words_ = np.frombuffer(stream, "<u4")
        place, states, crc = marks[part]
        x = np.frombuffer(states, "<u8").astype(np.uint64)
        n = min(n - part * STEPS * LANES, STEPS * LANES)
        out = np.empty((-(-n // LANES), LANES), np.uint32)
        mask, shift, scale, floor = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(BITS), np.uint64(1 << 31)
        for t in range(len(out)):
            slot = x & mask
            s = self.symbol[slot]
            out[t] = s
            x = self.freq[s] * (x >> scale) + slot - self.below[s]
            need = x < floor
            k = int(need.sum())
            x[need] = (x[need] << shift) | words_[place:place + k]
            place += k
        ids = out.ravel()[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a coded run of ids does not hold")
        return ids


BLOCKS = ("file int, block int, start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
          "checkpoints array<struct<place: long, states: binary, crc: long>>, words binary")


def _encode(freq: np.ndarray, kind: np.dtype):
    def block(coder: Coder, file: int, seq: int, start: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        every = np.frombuffer(b"".join(ids), kind)
        stream, marks = coder.encode(every)
        at = [{"place": p, "states": s, "crc": c} for p, s, c in marks]
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([len(every)], pa.int64()),
             pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // kind.itemsize for x in ids]], pa.list_(pa.int64())),
             pa.array([at], pa.list_(pa.struct([("place", pa.int64()), ("states", pa.binary()), ("crc", pa.int64())]))), pa.array([stream], pa.binary())],
            names=["file", "block", "start", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = Coder(freq), TaskContext.get().partitionId()
        docs, ids, held, seq, start = [], [], 0, 0, 0
        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(d)
                ids.append(x.as_py())
                held += len(ids[-1]) // kind.itemsize
                if held >= BLOCK:
                    yield block(coder, file, seq, start, docs, ids)
                    docs, ids, held, seq, start = [], [], 0, seq + 1, start + held
        if docs:
            yield block(coder, file, seq, start, docs, ids)

    return run


def write_ids(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 2) -> str:
    """Tokenise ``docs`` and write ``folder``/blocks (one file a range of doc_id) and
    ``folder``/table (the shared frequencies); returns the folder, by default a new
    one in the cluster's shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    w = words(vocabulary)
    kind, size = w.kind, w.model.get_vocab_size()
    tokenised(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    freq = frequencies(tokens, kind, size)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").write.parquet(f"{folder}/table")
    order = ["doc_id", "k1", "k2"]
    ranged = tokens.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids").mapInArrow(_encode(freq, kind), BLOCKS).write.parquet(f"{folder}/blocks")
    return folder


def _decode(freq: np.ndarray, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(freq)
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                marks = [(m["place"], m["states"], m["crc"]) for m in r["checkpoints"]]
                ids = np.concatenate([coder.decode(r["words"], marks, r["n_ids"], p) for p in range(len(marks))] or [np.empty(0, np.uint32)])
                n = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                cut = [ids[b - k:b].astype("<u4").tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                last = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), r["file"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - n), pa.array(n), last],
                                                 names=["file", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the ids (binary,
    little-endian unsigned 32-bit) or, with ``digest``, their crc32."""
    rows = spark.read.parquet(f"{folder}/table").collect()      # one row an id of the vocabulary at most
    freq = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    # one row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("before"))
    last = "ids_crc32" if digest else "ids"
    ids = blocks.mapInArrow(_decode(freq, digest), f"file int, doc_id long, at long, n_tokens long, {last} {'long' if digest else 'binary'}")
    return ids.join(F.broadcast(files), "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last)
