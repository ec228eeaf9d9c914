"""The preparation as ML stages: saved with the classifier, loaded elsewhere, equal to the parts."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskframe import config
from riskframe.operators import features, models, stages
from riskframe.plans import common
from riskframe.sources import io

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    raw = common.raw(spark, sf_small)
    return raw, stages.fit_application_model(raw)


def test_loaded_in_another_process(spark, sf_small, fitted, tmp_path):
    raw, model = fitted
    path = str(tmp_path / "model")
    io.save_model(model, path)
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from riskframe.session import build_session
from riskframe.plans import common
from riskframe.sources import io
spark = build_session("local[2]", shuffle_partitions=4)
out = io.load_pipeline_model({path!r}).transform(common.raw(spark, {sf_small!r}).where("ID % 50 < 3"))
print("ROWS" + out.select("id", "predicted_probability").toPandas().to_json(orient="values"))
"""
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    line = next(x for x in told.stdout.splitlines() if x.startswith("ROWS"))
    there = {i: p for i, p in json.loads(line[4:])}
    here = {r.id: r.predicted_probability for r in model.transform(raw.where("ID % 50 < 3")).select("id", "predicted_probability").collect()}
    assert there.keys() == here.keys() and len(here) > 50
    assert max(abs(there[i] - here[i]) for i in here) < 1e-9


def test_equals_the_separate_steps(spark, sf_small, fitted):
    raw, model = fitted
    keep = ["id", "dataset", "status", *config.SCALED_COLS]
    enc = features.prepared_encoded(raw, config.FIXTURE_CATEGORICALS, keep=keep)
    names = [c for c in enc.columns if c not in ("id", "dataset", "status")]
    assert stages.feature_names(model) == names
    mine = model.transform(raw).select("id", *[F.col(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)], F.col("predicted_probability").alias("p"))
    lr = models.fit_logistic(enc.where("dataset = 'train'"), names)
    theirs = models.score_model(lr, enc, names, ["id", *names]).withColumnRenamed("id", "id2")
    j = mine.join(theirs, F.col("id") == F.col("id2"))
    off = [F.max(F.abs(F.col(f"m{i}") - F.col(f"`{n}`"))).alias(f"d{i}") for i, n in enumerate(names)]
    row = j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p") - F.col("predicted_probability"))).alias("dp"), *off).first().asDict()
    assert row.pop("n") == enc.count() and row.pop("dp") < 1e-6 and max(row.values()) < 1e-9


def test_unknown_levels_missing_values_and_other_columns(spark, fitted):
    raw, model = fitted
    some = raw.limit(1).drop("Region").withColumns({"Region": F.lit("nowhere before"), "income": F.lit(None).cast("double"), "extra": F.lit(1)})
    row = model.transform(some).first().asDict()
    assert all(v == 0.0 for k, v in row.items() if k.startswith("region_")) and row["extra"] == 1
    assert 0 < row["predicted_probability"] < 1
    assert model.transform(raw.limit(0)).count() == 0


def test_empty_condition_fits_on_every_row(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a")], "x double, c string")
    m = stages.FillMissing(numeric=["x"], categorical=["c"]).fit(df)
    assert sorted(map(tuple, m.transform(df).collect())) == [(1.0, "a"), (2.0, "a"), (3.0, "a")]
    with pytest.raises(ValueError, match="levels"):
        stages.EncodeLevels(categorical=["c"], numeric=["x"], maxLevels=0).fit(df)
