"""SparkSession construction and lineage helpers.

The library never assumes a machine-local scratch folder: checkpoints go to
``spark.checkpoint.dir`` as configured by the cluster.  Only when that setting
is absent (local runs, tests) do we point it at a folder we are given.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; every one is a public Spark configuration.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "riskframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session.  When unset (tests,
    local runs) a fallback is used and installed, so later ``checkpoint()``
    calls work; ``local[...]`` masters may do without one, as driver and
    executors are one process there.  Any other master without the setting is
    an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    path = fallback
    if path is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="riskframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one).

    The input is persisted while the checkpoint is written so that it is
    computed once (a bare checkpoint computes it twice), then released; the
    returned frame reads the checkpoint files, so later stages and retries
    after a lost executor do not replay the upstream plan.
    """
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


@contextmanager
def read_once(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept by the executors while several passes read it, released behind them.

    A frame that its caller keeps already stays kept.
    """
    if df.storageLevel != StorageLevel.NONE:
        yield df
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def through_files(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """Write ``df`` once to a folder of its own beside the checkpoints and read it back.

    Cuts the lineage as ``cut_lineage`` does, in one job; the reader packs small
    files, so many short partitions cost later passes little.  ``by`` names the
    columns of few values that later passes select on: each value has files of its own.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
