"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a frame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import stages
from riskframe.llm.common import written

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_dedup", stages.simhash_dedup),
    ("decontaminate", stages.decontaminate),
    ("byte_bpe", stages.byte_bpe),
]

#: SimHash, Viterbi labels and BPE have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; one row per kept document with its token ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
