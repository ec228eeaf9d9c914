"""Byte-level BPE encoding and decoding through a sentencepiece model.

The rank file is serialised directly into a sentencepiece BPE model: every
byte becomes one printable code point, every token the piece of its mapped
bytes, its score the negative rank, and the normaliser the identity.  Merging
the best-scored pair first, leftmost on ties, is then the rank merge of the
vocabulary.  Texts are cut by the pre-token pattern; each pre-token is encoded
separately and decoded by the inverse byte map.

Map-only: no shuffle, bounded memory (texts pass in slices; the pre-token cache
is bounded).  Defined results: a null or empty text has no ids and decodes to
the empty string; repeated rows give repeated results; a null doc_id is passed
on; any text length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb

from .common import Memo, binary_rows, documents, gathered, looked_up, slices, spaced_parts, words_and_marks

FIRST = 0x100          # byte b is the code point FIRST + b
MAPPED = {b: FIRST + b for b in range(256)}
#: White_Space of Unicode, which the rank library's \\s means; Python's differs at U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Marks of which a run behind letters is one pre-token.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SLICE = 2 << 20        # bytes of text handled at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(MAPPED)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece 1 + i is the token of i-th rank."""
    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(ranks) + 1
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        m.pieces.add(piece=mapped(token), score=-float(rank))
    return m.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary; ``ids`` are little-endian uint32."""

    def __init__(self, path: str, pattern: str, cache: int = 1 << 19):
        #: only of this pattern is it known that a space between two other characters starts a pre-token
        self.spaced = pattern == public_tokenizers.PATTERN
        ranks = read_ranks(path)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of = np.array([0] + [r for _, r in order], dtype="<u4")   # piece -> id
        # a pre-token that is itself a token has that id, as in the rank merge's first step
        # (as_str keys only: a token that is no whole UTF-8 string can't be a pre-token)
        seed = {}
        for token, r in order:
            try:
                seed[token.decode()] = np.uint32(r).astype("<u4").tobytes()
            except UnicodeDecodeError:
                pass
        self.cache = Memo(self._pieces, cache, seed=seed)
        self.parts = Memo(self._after_space, cache // 2)
        # inverse mapping: piece text -> bytes, laid out by id
        size = max(ranks.values(), default=-1) + 1
        pieces: list[bytes] = [b""] * size
        for i, (_, r) in enumerate(order):
            pieces[r] = bytes(ord(c) - FIRST for c in self.model.id_to_piece(i + 1))
        self.lengths = np.array([len(x) for x in pieces] or [0], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token: its mapped bytes through the sentencepiece model."""
        texts = [w.encode().decode("latin-1").translate(MAPPED) for w in words]
        return [self.rank_of[x].tobytes() for x in self.model.encode(texts, num_threads=1)] if texts else []

    def _whole(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        self.cache.fill(itertools.chain.from_iterable(cut))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _after_space(self, parts: list[str]) -> list[bytes | None]:
        """Ids of " " + part; None where the cut before that space isn't certain.

        A space between two other characters that are not white space always
        starts a pre-token, so the ids on either side don't depend on each other.
        """
        good = [p for p in parts if p and p == p.strip()]
        ids = dict(zip(good, self._whole([" " + p for p in good]), strict=True))
        return [ids.get(p) for p in parts]

    def encode_array(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one run, and where each text's end."""
        if not self.spaced:
            whole = self._whole([t or "" for t in text.to_pylist()])
            return gathered(whole, np.arange(len(whole)), np.ones(len(whole), np.int64), "<u4")
        which, counts, parts = spaced_parts(text)
        first = np.cumsum(counts) - counts
        inner = np.ones(len(which), bool)
        inner[first] = False
        simple, core, tail = words_and_marks(parts, MARKS)
        ids = np.empty(len(parts), object)
        ids[simple] = [a + b for a, b in zip(looked_up(self.cache, pc.replace_substring_regex(core, "^", " ")), looked_up(self.cache, tail), strict=True)]
        ids[~simple] = looked_up(self.parts, parts.filter(pa.array(~simple)))
        ids = ids.tolist()
        unsure = np.fromiter((x is None for x in ids), bool, len(ids))
        bad = np.add.reduceat(unsure[which] & inner, first) > 0 if len(first) else np.empty(0, bool)
        heads = parts.take(pa.array(which[first])).to_pylist()
        bad |= (counts > 1) & np.fromiter((h != h.rstrip() for h in heads), bool, len(heads))
        # a text's first part has no space before it; an unsure text is encoded whole in its place
        odd = np.flatnonzero(bad)
        for i, t in zip(odd.tolist(), text.take(pa.array(odd)).to_pylist(), strict=True):
            heads[i] = t
        which[first] = len(parts) + np.arange(len(heads))
        keep = ~(np.repeat(bad, counts) & inner)
        values = [x or b"" for x in ids] + self._whole(heads)
        return gathered(values, which[keep], np.where(bad, 1, counts), "<u4")

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        return binary_rows(*self.encode_array(pa.array(texts, pa.string()))).to_pylist()

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_array(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids by the inverse mapping, and where the bytes of each run up to ``ends`` end."""
        out = [np.empty(0, np.uint8)]
        for at in range(0, len(ids), 1 << 20):
            x = ids[at:at + (1 << 20)]
            n = self.lengths[x]
            last = np.cumsum(n)
            where = np.repeat(self.starts[x] - (last - n), n) + np.arange(last[-1])
            out.append(self.blob[where])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(self.lengths[ids])])[ends]

    def decode(self, ids: bytes) -> bytes:
        every = np.frombuffer(ids, dtype="<u4")
        return self.decode_array(every, np.array([len(every)]))[0].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, cache: int = 1 << 19) -> Codec:
    """One codec a Python worker."""
    return Codec(path, pattern, cache)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


CHECKED = T.StructType([*ENCODED.fields, T.StructField("decoded_sha256", T.StringType())])


def _mapped(df: DataFrame, schema: T.StructType, column: str, fn) -> DataFrame:
    """``fn(array) -> columns`` behind doc_id, for slices of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *fn(part.column(column))], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = documents(docs, id_col, text_col)
    return d.select(d["doc_id"].cast("long").alias("doc_id"), "text")


def _digests(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """sha256 of the items of ``data`` up to each of ``ends``."""
    raw, ends = memoryview(np.ascontiguousarray(data)).cast("B"), (ends * data.itemsize).tolist()
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in itertools.pairwise([0, *ends])], pa.string())


def _counts(ends: np.ndarray) -> pa.Array:
    return pa.array(np.diff(ends, prepend=0))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 1 << 19) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every whole text."""
    def columns(text):
        ids, ends = codec(path, pattern, cache).encode_array(text)
        return _counts(ends), binary_rows(ids, ends)
    return _mapped(_ids(docs, id_col, text_col), ENCODED, "text", columns)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes (``text``, binary) of ``encode``'s rows."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType())])
    return _mapped(encoded.select("doc_id", "ids"), schema, "ids",
                   lambda every: [pa.array([codec(path, pattern).decode(ids or b"") for ids in every.to_pylist()], pa.binary())])


def encode_checked(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 1 << 19) -> DataFrame:
    """``encode`` with the sha256 of what the ids decode to."""
    def columns(text):
        c = codec(path, pattern, cache)
        ids, ends = c.encode_array(text)
        return _counts(ends), binary_rows(ids, ends), _digests(*c.decode_array(ids, ends))
    return _mapped(_ids(docs, id_col, text_col), CHECKED, "text", columns)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cache: int = 1 << 19) -> DataFrame:
    """Encode and decode again; the digests of the ids and of the decoded bytes."""
    def columns(text):
        c = codec(path, pattern, cache)
        ids, ends = c.encode_array(text)
        return _counts(ends), _digests(ids, ends), _digests(*c.decode_array(ids, ends))
    return _mapped(_ids(docs, id_col, text_col), DIGESTS, "text", columns)
