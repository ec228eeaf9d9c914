"""Ranked lexical search by pipelined term partitioning.

Documents lie in blocks; a block keeps one posting list a term.  Terms belong
to owners, one a stage, by their weight: the rarest terms' owner comes first.
A bundle, the items of one chunk over one block, travels through the owners'
stages; each stage cogroups it with the owner's lists for that block and adds
their integer contributions to the bundle's sparse document accumulators.  An
accumulator is left behind only when it can no longer reach its item's k-th
score within the block, whatever the later owners add.  What arrives behind the
last owner is ranked over all blocks.

A block is bounded by its text, a chunk by its number of items, so a term in a
third of all documents is spread over all blocks and no list of a whole term is
ever held.  Defined results: every row of the documents is a document, repeated
rows too; a null doc_id is passed on and ranks behind others of its score; a
null text or one without a term takes no part; items equal in id and text count
once, and equal texts under different ids each; an item without a term, or
whose terms occur nowhere, has no row; without documents the result is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import top_k_per_group
from ..session import checkpoint_dir
from .common import ascii_lower, binary_rows, documents, row_key, slices, written

#: What is no part of a term.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STAGES = 4
BLOCK = 8 << 20                # bytes of text in a block (a longer text is one by itself)
CHUNK = 1024                   # items of a bundle, about
SALTS = 16
MOST = 1_000_000               # what a term's occurrences give for each unit of its weight, at most

#: Bytes with A-Z in lower case and everything between terms blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
FOLD[0x41:0x5B] += 0x20

POSTINGS = "block long, term string, n_docs long, n_terms long, docs binary, tfs binary, doc_ids array<long>, sizes binary"
BUNDLE = ("block long, chunk int, doc_ids array<long>, sizes binary, items array<long>, rest array<long>, "
          "at_item binary, at_doc binary, score binary")


def block_of(block: int, doc_ids: pa.Array, text: pa.Array) -> list[pa.RecordBatch]:
    """The posting lists of one block, and a row (term null) of its documents and their sizes."""
    text = pa.concat_arrays([text.cast(pa.large_string())])
    _, offsets, values = text.buffers()
    folded = FOLD[np.frombuffer(values, np.uint8)] if values is not None else np.empty(0, np.uint8)
    text = pa.LargeStringArray.from_buffers(len(text), offsets, pa.py_buffer(folded), offset=text.offset)
    cut = pc.ascii_split_whitespace(text)
    doc, word = pc.list_parent_indices(cut), pc.list_flatten(cut)
    some = pc.greater(pc.binary_length(word), 0)
    doc, word = doc.filter(some).to_numpy().astype(np.int64), word.filter(some).dictionary_encode()
    n = len(text)
    key, tf = np.unique(word.indices.to_numpy().astype(np.int64) * n + doc, return_counts=True)
    term, at = np.divmod(key, n)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.bincount(doc, minlength=n)
    names = [c.split()[0] for c in POSTINGS.split(", ")]
    listed, ends = len(starts), np.append(starts, len(term))[1:]
    lists = [np.full(listed, block), word.dictionary.take(pa.array(term[starts])).cast(pa.string()), np.diff(starts, append=len(term)),
             np.add.reduceat(tf, starts) if listed else tf, binary_rows(at.astype("<u4"), ends), binary_rows(tf.astype("<u4"), ends),
             pa.nulls(listed, pa.list_(pa.int64())), pa.nulls(listed, pa.binary())]
    own = [[block], pa.nulls(1, pa.string()), [int((sizes > 0).sum())], [int(sizes.sum())], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
           pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), [sizes.astype("<i8").tobytes()]]
    return [pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names) for cols in (own, lists)]


def postings(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The blocks' posting lists, in the shared folder: their numbers hold from then on."""
    d = documents(docs)
    d = d.select(d["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            return block_of(number, *(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text")))

        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                more = pc.sum(pc.binary_length(part.column("text"))).as_py()
                if held and size + more > block_bytes:
                    yield from close()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield from close()

    return written(d.mapInArrow(run, POSTINGS), "search-postings")


def owned_lists(lists: DataFrame, items: DataFrame, n_docs: int, stages: int) -> tuple[DataFrame, DataFrame]:
    """The terms of the items with their weights and owners, and the owners' posting lists, each
    with the items of a chunk that ask for it."""
    df = lists.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    most = int(1000 * np.log((2 * n_docs + 2) / 3)) + 1
    owner = F.greatest(F.lit(0), stages - 1 - F.floor(F.col("w") * stages / most)).cast("int")
    terms = items.select("item", "chunk", F.explode("terms").alias("term")).join(df, "term").withColumn("w", weight).withColumn("stage", owner)
    terms = written(terms.select("item", "chunk", "term", "w", "stage"), "search-terms")
    asked = terms.groupBy("term", "chunk", "w", "stage").agg(F.sort_array(F.collect_list("item")).alias("asking"))     # at most a chunk's items
    owned = lists.where("term is not null").select("block", "term", "docs", "tfs").join(asked, "term")
    folder = f"{checkpoint_dir(lists.sparkSession)}/search-owned-{uuid.uuid4().hex}"
    owned.select("stage", "block", "chunk", "w", "asking", "docs", "tfs").write.partitionBy("stage").parquet(folder)
    schema = "block long, chunk int, w long, asking array<long>, docs binary, tfs binary, stage int"
    return terms, lists.sparkSession.read.schema(schema).parquet(folder)


def first_bundles(lists: DataFrame, terms: DataFrame, n_chunks: int, stages: int) -> DataFrame:
    """One bundle a block and chunk, with empty accumulators and, per item, the most that the
    owners behind each stage can add."""
    rest = [F.sum(F.when(F.col("stage") > s, F.col("w") * MOST).otherwise(0)).alias(f"r{s}") for s in range(stages)]
    bounds = terms.groupBy("chunk", "item").agg(F.array(*rest).alias("rest"))
    chunks = bounds.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("item", "rest"))).alias("members"))     # at most a chunk's items
    blocks = lists.where("term is null and n_docs > 0").select("block", "doc_ids", "sizes")
    # every item is asked of every block: the chunks' numbers first, their members joined by the
    # number; a chunk meets all blocks, so it is dealt out SALTS times
    every = blocks.withColumns({"salt": F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))})
    chunks = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return every.join(chunks, ["chunk", "salt"]).select(
        "block", "chunk", "doc_ids", "sizes", F.col("members.item").alias("items"), F.flatten("members.rest").alias("rest"),
        *[F.lit(None).cast("binary").alias(c) for c in ("at_item", "at_doc", "score")])


def norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length against the average: 10 + 90 n N div L."""
    if 90 * n_docs * int(sizes.max(initial=0)) < 1 << 63:
        return 10 + 90 * n_docs * sizes // n_terms
    return np.array([10 + 90 * n_docs * n // n_terms for n in sizes.tolist()], np.int64)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows in one array, and where each row's begin and end."""
    rows = column.to_pylist()
    ends = np.cumsum([0, *map(len, rows)]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(rows), kind).astype(np.int64), ends


def _stage(stage: int, stages: int, n_docs: int, n_terms: int, k: int):
    """One owner's work on a bundle."""
    last = stage == stages - 1

    def run(bundle: pa.Table, lists: pa.Table) -> pa.Table:
        if not bundle.num_rows:                          # lists of a block without a bundle: none
            return pa.table({c: pa.array([], t) for c, t in (("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()))}) if last else bundle
        row = bundle.select(["items", "doc_ids"]).to_pylist()[0]
        items = np.array(row["items"], np.int64)
        rest = np.array(bundle.column("rest")[0].as_py(), np.int64).reshape(len(items), stages)[:, stage]
        sizes = np.frombuffer(bundle.column("sizes")[0].as_py(), "<i8")
        old_item, old_doc, old_score = (np.frombuffer(bundle.column(c)[0].as_py() or b"", t).astype(np.int64)
                                        for c, t in (("at_item", "<u4"), ("at_doc", "<u4"), ("score", "<i8")))
        old = np.searchsorted(old_item, np.arange(len(items) + 1))
        # what every occurrence in the owner's lists adds
        docs, ends = _joined(lists.column("docs"), "<u4")
        tfs, _ = _joined(lists.column("tfs"), "<u4")
        weights = np.repeat(lists.column("w").to_numpy().astype(np.int64), np.diff(ends))
        adds = weights * (1_000_000_000 * tfs // (1000 * tfs + 8 * norms(sizes, n_docs, n_terms)[docs]))
        asking = lists.column("asking").to_pylist()
        of_list = np.repeat(np.arange(len(asking)), [len(x) for x in asking])
        of_item = np.searchsorted(items, np.array([i for x in asking for i in x], np.int64))
        order = np.argsort(of_item, kind="stable")
        of_list, cuts = of_list[order].tolist(), np.searchsorted(of_item[order], np.arange(len(items) + 1)).tolist()

        totals, out = np.zeros(len(sizes), np.int64), []
        for i in range(len(items)):
            totals[:] = 0
            totals[old_doc[old[i]:old[i + 1]]] = old_score[old[i]:old[i + 1]]
            for j in of_list[cuts[i]:cuts[i + 1]]:
                a, b = ends[j], ends[j + 1]
                totals[docs[a:b]] += adds[a:b]           # a document is once in a list
            at = np.flatnonzero(totals)
            score = totals[at]
            if len(at) > k:                              # who can't reach the k-th any more stays behind
                reach = score + rest[i] >= np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[reach], score[reach]
            if len(at):
                out.append((np.full(len(at), i), at, score))
        item, doc, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 3
        if not last:
            held = {"at_item": item.astype("<u4"), "at_doc": doc.astype("<u4"), "score": score.astype("<i8")}
            for c, x in held.items():
                bundle = bundle.set_column(bundle.schema.get_field_index(c), c, pa.array([x.tobytes()], pa.binary()))
            return bundle
        ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
        return pa.table({"item": pa.array(items[item]), "doc_id": ids, "score": pa.array(score, pa.int64())})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, stages: int = STAGES, block_bytes: int = BLOCK, chunk: int = CHUNK,
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents of a score above 0."""
    spark = docs.sparkSession
    asked = row_key(documents(items, item_col, item_text)).dropDuplicates(["__k1", "__k2"])
    words = F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), GAP), ""))
    asked = asked.select(F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("item_id"), words.alias("terms"))
    asked = written(asked, "search-items")               # numbers hold from here on
    chunks = max(1, -(-asked.count() // chunk))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int"))

    lists = postings(docs, block_bytes)
    n_docs, n_terms = lists.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    terms, owned = owned_lists(lists, asked, n_docs, stages)
    bundles = first_bundles(lists, terms, chunks, stages)
    for s in range(stages):
        own = owned.where(F.col("stage") == s).drop("stage")
        bundles = (bundles.groupBy("block", "chunk").cogroup(own.groupBy("block", "chunk"))
                   .applyInArrow(_stage(s, stages, n_docs, n_terms, k), BUNDLE if s < stages - 1 else "item long, doc_id long, score long"))
    best = top_k_per_group(bundles, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "doc_id")
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
