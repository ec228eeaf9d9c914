"""Sources and sinks: CSV, name lists, metrics JSON, partitioned output, models."""

import json
import os

import pytest
from pyspark.sql import functions as F

from riskframe.sources import io


def test_feature_names(spark, tmp_path):
    p = tmp_path / "names.txt"
    p.write_text("term\n  credit_score \n\nltv\n\n")
    rows = io.read_feature_names(spark, str(p)).orderBy("feature_index").collect()
    assert [(r.feature_index, r.feature) for r in rows] == [(0, "term"), (1, "credit_score"), (2, "ltv")]
    with pytest.raises(FileNotFoundError):
        io.read_feature_names(spark, str(tmp_path / "absent.txt"))
    e = tmp_path / "empty.txt"
    e.write_text("\n \n")
    with pytest.raises(ValueError):
        io.read_feature_names(spark, str(e))


def test_csv_round_trip_and_missing(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text("ID,Gender,LTV\n1,Male,80.5\n2,,\n")
    df = io.read_csv(spark, str(src), "ID long, Gender string, LTV double")
    rows = df.orderBy("ID").collect()
    assert rows[1].Gender is None and rows[1].LTV is None
    out = tmp_path / "out"
    io.write_csv(df, str(out))
    back = io.read_csv(spark, str(out), "ID long, Gender string, LTV double").orderBy("ID").collect()
    assert back == rows


def test_metrics_json(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"model": "x", "validation_metrics": {"auc_roc": 0.8, "auc_pr": 0.7, "brier_score": 0.1,
                                                                    "dataset": "validation"},
                             "test_metrics": {"auc_roc": 0.81, "auc_pr": 0.71, "brier_score": 0.11,
                                              "dataset": "test"}}, indent=4))
    df = io.read_metrics_json(spark, str(p), io.METRICS_SCHEMA)
    assert df.select(F.col("validation_metrics.auc_roc")).collect()[0][0] == 0.8
    comp = spark.createDataFrame([("x", "validation", 0.8, 0.7, 0.1), ("x", "test", 0.81, 0.71, 0.11)],
                                 "model string, dataset string, auc_roc double, auc_pr double, brier_score double")
    doc = io.metrics_document(comp, "x")
    out = tmp_path / "doc"
    io.write_json(doc, str(out))
    back = io.read_metrics_json(spark, str(out), io.METRICS_SCHEMA).collect()[0]
    assert back.test_metrics.auc_roc == 0.81 and back.validation_metrics.dataset == "validation"


def test_partitioned_sink_only_successful(spark, tmp_path):
    df = spark.createDataFrame([(1, True, 0.2), (2, False, None), (1, True, 0.3)],
                               "case_id long, success boolean, p double")
    out = tmp_path / "cfs"
    io.write_partitioned(df, str(out), "case_id")
    assert sorted(d for d in os.listdir(out) if d.startswith("case_id=")) == ["case_id=1"]


def test_model_save_load(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.2, 0.0), (0.9, 1.0)], "x double, status double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                            LogisticRegression(labelCol="status", maxIter=10)]).fit(df)
    io.save_model(pipe, str(tmp_path / "m"))
    loaded = io.load_pipeline_model(str(tmp_path / "m"))
    assert loaded.transform(df).count() == 4
