"""Per-case output in bounded files, committed as a whole.

A folder a case and task makes cases x tasks files.  Here rows are clustered by
case into files of at most ``rows_per_file`` rows, so files grow with the rows
alone, and a manifest says which files hold a case.  Layout below ``path``:

    rows/<commit>/      the rows, sorted by case
    cases/<commit>/     the manifest: case_key, file_name, n_rows
    commits/            one row a commit, written last

Readers start from the newest row of ``commits``: they see all rows of a write
or none, and a write that fails leaves the one before it in force.

Defined results: a null case is a case; repeated rows stay; a case of more rows
than a file spans several; an empty table commits no cases; cases without a
successful row are absent.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

ROWS_PER_FILE = 1_000_000
COMMITS = "commit string, sequence long, format string, key string, schema string, n_rows long"
#: Every text comes back as written, empty ones, blanks, quotes and newlines included (but one that is a single NUL, in CSV).
OPTIONS = {"header": True, "multiLine": True, "lineSep": "\n", "quoteAll": True, "escape": "\\", "charToEscapeQuoteEscaping": "\\",
           "nullValue": "\0", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_cases(df: DataFrame, path: str, key: str, rows_per_file: int = ROWS_PER_FILE, fmt: str = "csv",
                only_successful: bool = True) -> str:
    """Write the rows clustered by ``key`` and commit them; the commit's name.

    ``only_successful`` keeps successful rows only when a ``success`` flag is there.
    """
    spark = df.sparkSession
    if only_successful and "success" in df.columns:
        df = df.where(F.col("success"))
    df = cut_lineage(df)                      # counted, sampled and written: the same rows each time
    rows, commit = df.count(), uuid.uuid4().hex
    order = [F.col(key), F.xxhash64(*df.columns)]      # the hash splits a case with most rows
    clustered = df.repartitionByRange(max(1, -(-rows // rows_per_file)), *order).sortWithinPartitions(*order)
    clustered.write.format(fmt).options(**OPTIONS).option("maxRecordsPerFile", rows_per_file).save(f"{path}/rows/{commit}")
    held = _rows(spark, f"{path}/rows/{commit}", fmt, df.schema).select(F.col(key).alias("case_key"), "_metadata.file_name")
    held.groupBy("case_key", "file_name").agg(F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/cases/{commit}")
    before = _commits(spark, path)
    sequence = 1 if before is None else (before.agg(F.max("sequence")).first()[0] or 0) + 1
    row = spark.createDataFrame([(commit, sequence, fmt, key, df.schema.json(), rows)], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return commit


def read_cases(spark: SparkSession, path: str, cases: list | None = None) -> DataFrame:
    """The rows of the newest commit; with ``cases`` only theirs, from the files that hold them."""
    last = _newest(spark, path)
    schema, folder = T.StructType.fromJson(json.loads(last["schema"])), f"{path}/rows/{last['commit']}"
    if cases is None:
        return _rows(spark, folder, last["format"], schema)
    wanted = _any_of("case_key", cases)
    files = manifest(spark, path).where(wanted).select("file_name").distinct().collect()     # of the cases asked for
    if not files:
        return spark.createDataFrame([], schema)
    return _rows(spark, [f"{folder}/{r.file_name}" for r in files], last["format"], schema).where(_any_of(last["key"], cases))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """case_key, file_name, n_rows of the newest commit."""
    return spark.read.parquet(f"{path}/cases/{_newest(spark, path)['commit']}")


def _any_of(column: str, cases: list):
    found = F.col(column).isin([c for c in cases if c is not None])
    return found | F.col(column).isNull() if None in cases else found


def _rows(spark: SparkSession, where: str | list[str], fmt: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).format(fmt).options(**OPTIONS).load(where)


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _newest(spark: SparkSession, path: str):
    commits = _commits(spark, path)
    row = commits.orderBy(F.col("sequence").desc(), F.col("commit").desc()).first() if commits is not None else None
    if row is None:
        raise FileNotFoundError(f"no committed cases at {path}")
    return row
