"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all of ``docs``.

All but the last return the columns of ``documents``.  Defined results follow
the operators'; rows are told apart by (doc_id, text), so repeated rows share
their fate, and only one of a near-duplicate group stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, langid, linededup, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter in the text) go; ``lang`` becomes the prediction.

    Learns from the labelled rows of ``docs`` that aren't held out; without any,
    every language is unknown and the text alone decides who goes."""
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    if model is None:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.lit(langid.UNKNOWN)).select(COLUMNS)
    found = langid.annotate(docs.select(COLUMNS), model).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 documents or more stay in the first alone; no document goes."""
    docs = docs.select(COLUMNS)
    bitmaps = linededup.keep_bitmaps(docs, min_docs=10, keep_first=True, min_chars=1)
    return linededup.apply_bitmaps(docs, bitmaps).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays."""
    return simhash.keep_one(docs.select(COLUMNS), shingle=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the sha256 of the decoded bytes."""
    return bytebpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=1 << 17)
