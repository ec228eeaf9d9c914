"""File sources and sinks of the workflow (CSV, name lists, metrics JSON, models).

Readers take explicit schemas (no inference pass over large inputs); sinks
use Spark writers, so output is written by the executors in parallel.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; empty fields become NULL.  Give a schema for large files."""
    r = spark.read.option("header", True).option("emptyValue", None).option("nullValue", "")
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """(feature_index, feature): stripped non-blank lines in file order.

    Raises FileNotFoundError when the file is absent and ValueError when it
    holds no names.  A name list is one small file: it is read whole.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:      # Spark's reader knows every kind of path
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no name list at {path}") from None
        raise
    lines = text.select(
        F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("pos", "line"))
    names = lines.select("pos", F.trim("line").alias("feature")).where(F.col("feature") != "")
    out = names.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("feature_index"), "feature")
    if out.limit(1).count() == 0:
        raise ValueError(f"the name list at {path} is empty")
    return out


METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("validation_metrics", T.StructType([
        T.StructField("auc_roc", T.DoubleType()), T.StructField("auc_pr", T.DoubleType()),
        T.StructField("brier_score", T.DoubleType()), T.StructField("dataset", T.StringType())])),
    T.StructField("test_metrics", T.StructType([
        T.StructField("auc_roc", T.DoubleType()), T.StructField("auc_pr", T.DoubleType()),
        T.StructField("brier_score", T.DoubleType()), T.StructField("dataset", T.StringType())])),
])


def read_metrics_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A (multi-line) metrics document; nested fields via ``col("validation_metrics.auc_roc")``."""
    r = spark.read.option("multiLine", True)
    return r.schema(schema).json(path) if schema is not None else r.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, key: str, only_successful: bool = True) -> None:
    """One folder per key value (e.g. per case), successful cases only when a flag is present."""
    if only_successful and "success" in df.columns:
        df = df.where(F.col("success"))
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def metrics_document(comparison: DataFrame, model: str) -> DataFrame:
    """One JSON-ready row: model + validation_metrics{...} + test_metrics{...}."""
    def part(ds):
        c = comparison.where((F.col("model") == model) & (F.col("dataset") == ds))
        return c.select(F.struct(F.col("auc_roc"), F.col("auc_pr"), F.col("brier_score"),
                                 F.lit(ds).alias("dataset")).alias(f"{ds}_metrics"))
    v, t = part("validation"), part("test")
    return v.unionByName(t, allowMissingColumns=True).agg(
        F.first("validation_metrics", ignorenulls=True).alias("validation_metrics"),
        F.first("test_metrics", ignorenulls=True).alias("test_metrics")).select(
        F.lit(model).alias("model"), "validation_metrics", "test_metrics")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; a metrics document is one row, so it lands in one file."""
    df.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
