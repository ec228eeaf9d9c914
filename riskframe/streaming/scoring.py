"""Structured Streaming: score applications as order files arrive.

Orders are read as a file stream and joined to the static customer table
(stream-static inner join, stateless).  The transform is the same fitted,
map-only preparation as in batch, so stream output equals batch output.
Sinks live under the session's checkpoint folder (shared storage on a
cluster); the availableNow trigger processes what is there and stops.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import counterfactual as cf
from ..operators import features, models
from ..session import checkpoint_dir
from ..sources import tables


def application_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    # The table may be one file or a folder of part files.  A file stream
    # watches a folder: given as a glob, the path's own name matches either
    # the single file or, as a folder, is expanded to the files in it.
    path = os.path.join(sf_dir, "orders.parquet")
    schema = spark.read.parquet(path).select(*tables.ORDER_COLS).schema
    orders = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(os.path.join(sf_dir, "orders[.]parquet")))
    # a micro-batch of one file with a few row groups is dealt over the cores
    orders = orders.repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    customers = tables.table(spark, sf_dir, "customer", tables.CUSTOMER_COLS)
    return tables.applications_from(orders, customers)


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def _run_to_end(scored: DataFrame, name: str) -> DataFrame:
    """Run a stateless stream to completion; its sink as a batch frame."""
    spark = scored.sparkSession
    out, ck = _paths(spark, name)
    q = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


def score_stream(spark: SparkSession, sf_dir: str, prep: features.PrepModel) -> DataFrame:
    """Run the scoring stream to completion; returns the sink as a batch frame."""
    return _run_to_end(models.score_linear(prep.transform(application_stream(spark, sf_dir))), "scores")


def model_stream(spark: SparkSession, sf_dir: str, model) -> DataFrame:
    """Raw applications through a saved pipeline model as they arrive."""
    scored = model.transform(application_stream(spark, sf_dir))
    return _run_to_end(scored.select("id", "dataset", "status", "predicted_probability", "predicted_label"), "model-scores")


def counterfactual_stream(spark: SparkSession, sf_dir: str, prep: features.PrepModel,
                          ranges: dict[str, tuple[float, float]],
                          threshold: float = config.HIGH_RISK_THRESHOLD) -> DataFrame:
    """Counterfactuals for every arriving application scored above ``threshold``.

    ``foreachBatch`` runs the batch search on each micro-batch and writes it
    to its own epoch folder with overwrite, so a replayed epoch after a
    failure replaces its earlier output instead of duplicating it.
    """
    prepared = prep.transform(application_stream(spark, sf_dir))
    scored = models.score_linear(prepared, keep=["id", "dataset", "status", *config.MUTABLE_FEATURES])
    out, ck = _paths(spark, "counterfactuals")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        rejected = batch.where(F.col("predicted_probability") > F.lit(threshold))
        cf.generate(rejected, ranges).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch_id}"))

    q = (scored.writeStream.foreachBatch(handle).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch")
