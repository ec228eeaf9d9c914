"""Scoring and model fitting.

Linear scores are plain column expressions (whole-stage codegen, no Python).
Fitted models use Spark ML; the network forward pass runs in ``mapInPandas``
with weights shipped once as a broadcast variable (their size is fixed by the
architecture, not by the data).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config


def linear_logit(coefficients: dict[str, float], intercept: float):
    z = F.lit(float(intercept))
    for name, w in coefficients.items():
        z = z + F.lit(float(w)) * F.col(name)
    return z


def sigmoid(z):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_linear(df: DataFrame, coefficients: dict[str, float] | None = None,
                 intercept: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """Probability, label (p >= 0.5) and the carried columns."""
    coefficients = config.SCORE_COEFFICIENTS if coefficients is None else coefficients
    intercept = config.SCORE_INTERCEPT if intercept is None else intercept
    keep = ["id", "dataset", "status"] if keep is None else keep
    p = sigmoid(linear_logit(coefficients, intercept))
    return df.select(*keep, p.alias("predicted_probability")).withColumn(
        "predicted_label", (F.col("predicted_probability") >= config.DECISION_THRESHOLD).cast("int"))


def as_prediction_records(scored: DataFrame, model: str) -> DataFrame:
    """(id, model, dataset, y, p) records consumed by the metrics module."""
    return scored.select("id", F.lit(model).alias("model"), "dataset",
                         F.col("status").alias("y"), F.col("predicted_probability").alias("p"))


# ---------------------------------------------------------------- Spark ML

def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def fit_logistic(train: DataFrame, features: list[str], C: float = 100.0, max_iter: int = 1000,
                 label: str = "status"):
    """``fit_logistic_vectors`` on the named columns."""
    return fit_logistic_vectors(assemble(train, features), C, max_iter, label)


def fit_logistic_vectors(train: DataFrame, C: float = 100.0, max_iter: int = 1000, label: str = "status"):
    """L2 logistic regression on a vector column ``features``, dense or sparse, matching sklearn's C on an unscaled design.

    sklearn minimises 0.5*||w||^2 + C*sum(loss); Spark minimises
    mean(loss) + 0.5*regParam*||w||^2, so regParam = 1 / (C * n).
    """
    from pyspark.ml.classification import LogisticRegression
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8)
    return lr.fit(train.withColumn(label, F.col(label).cast("double")))


def coefficient_table(spark, model, features: list[str]) -> DataFrame:
    """(feature_index, feature, coefficient) of a fitted linear model (size = #features)."""
    coefs = model.coefficients.toArray().tolist()
    if len(coefs) != len(features):
        raise ValueError(f"the model has {len(coefs)} coefficients, {len(features)} names were given")
    rows = [(i, f, float(c)) for i, (f, c) in enumerate(zip(features, coefs))]
    return spark.createDataFrame(rows, "feature_index int, feature string, coefficient double")


def score_model(model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    out = model.transform(assemble(df, features))
    return out.select(*keep, vector_to_array("probability")[1].alias("predicted_probability")).withColumn(
        "predicted_label", (F.col("predicted_probability") >= config.DECISION_THRESHOLD).cast("int"))


def fit_mlp(train: DataFrame, validation: DataFrame, features: list[str], hidden=((4,), (8,)), iterations=(20, 60),
            seed: int = 42, label: str = "status"):
    """Feed-forward classifier (Spark ML's MLP: sigmoid hidden layers, softmax output).

    Small nets, stopped where the validation AUC is best: each size is fitted
    for each number of iterations and the best on ``validation`` stays."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    t, v = (assemble(d, features).select(F.col(label).cast("double").alias(label), "features").persist(StorageLevel.MEMORY_AND_DISK)
            for d in (train, validation))
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability", numBins=0)
    try:
        best = None
        for sizes in hidden:
            for n in iterations:
                m = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(features), *sizes, 2],
                                                   maxIter=n, seed=seed, blockSize=128).fit(t)
                auc = ev.evaluate(m.transform(v))
                if best is None or auc > best[0]:
                    best = auc, m
        return best[1]
    finally:
        t.unpersist()
        v.unpersist()


def logistic_gradient(train: DataFrame, model, features: list[str], C: float, label: str = "status") -> DataFrame:
    """(feature_index, feature, gradient) of mean loss + ||w||^2 / (2 C n) at the fitted coefficients.

    One aggregate over the training rows; zero at the optimum.  The intercept
    (index -1) is not penalised."""
    w = [float(x) for x in model.coefficients]
    p = sigmoid(linear_logit(dict(zip(features, w, strict=True)), float(model.intercept)))
    r = train.select(*features, (p - F.col(label)).alias("_r"))
    row = r.agg(F.count(F.lit(1)).alias("_n"), F.avg("_r").alias("_g"), *[F.avg(F.col("_r") * F.col(f)).alias(f"_g{i}") for i, f in enumerate(features)]).first()
    rows = [(i, f, row[f"_g{i}"] + w[i] / (C * row["_n"])) for i, f in enumerate(features)] + [(-1, "intercept", row["_g"])]
    return train.sparkSession.createDataFrame(rows, "feature_index int, feature string, gradient double")


# ------------------------------------------------------- network forward pass

def _affine(x: np.ndarray, layer: dict) -> np.ndarray:
    """Dense layer, then the normalisation's scale and shift."""
    out = x @ np.asarray(layer["w"]) + np.asarray(layer["b"])
    return out * np.asarray(layer["scale"]) + np.asarray(layer["shift"]) if "scale" in layer else out


def network_forward(x: np.ndarray, network: list[dict]) -> np.ndarray:
    """Probability of class 1.

    A network is a list of parts: ``{"dense": layer}`` is dense, normalisation,
    ReLU (a change of width); ``{"block": [first, second]}`` is a residual block
    of two layers inside one skip, ReLU(second(ReLU(first(h))) + h);
    ``{"output": layer}`` is the final logit.  A layer has w, b and, with a
    normalisation, scale and shift.
    """
    h = x
    for part in network:
        if "dense" in part:
            h = np.maximum(_affine(h, part["dense"]), 0.0)
        elif "block" in part:
            first, second = part["block"]
            h = np.maximum(_affine(np.maximum(_affine(h, first), 0.0), second) + h, 0.0)
        else:
            h = 1.0 / (1.0 + np.exp(-_affine(h, part["output"])))
    return h.reshape(-1)


def save_network(spark, network: list[dict], path: str) -> None:
    """One JSON document of a few numbers a unit."""
    plain = json.dumps(network, default=lambda a: np.asarray(a).tolist())
    spark.createDataFrame([(plain,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_network(spark, path: str) -> list[dict]:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def score_network(df: DataFrame, features: list[str], network: list[dict], keep: list[str]) -> DataFrame:
    """Inference over a table: Arrow batches through numpy, weights broadcast once."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(network)
    schema = T.StructType([f for f in df.select(*keep).schema.fields] +
                          [T.StructField("predicted_probability", T.DoubleType())])

    def run(batches):
        net = bc.value
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=np.float64)
            out = pdf[keep].copy()
            out["predicted_probability"] = network_forward(x, net) if len(pdf) else np.zeros(0)
            yield out

    return df.select(*keep, *[c for c in features if c not in keep]).mapInPandas(run, schema).withColumn(
        "predicted_label", (F.col("predicted_probability") >= config.DECISION_THRESHOLD).cast("int"))


def rule_network(n_features: int, widths: tuple[int, ...] = (4, 3)) -> list[dict]:
    """A network whose weights follow a rule: one residual block per width, dense parts between them."""
    def layer(a, b, k, norm=True):
        out = {"w": [[((i * 7 + j * 3 + k) % 11 - 5) / 10.0 for j in range(b)] for i in range(a)],
               "b": [((j + k) % 5 - 2) / 10.0 for j in range(b)]}
        return out | ({"scale": [1.0 + ((j + k) % 3 - 1) / 4.0 for j in range(b)], "shift": [((j * 2 + k) % 7 - 3) / 20.0 for j in range(b)]} if norm else {})
    parts, size = [], n_features
    for k, width in enumerate(widths):
        parts += [{"dense": layer(size, width, 3 * k)}, {"block": [layer(width, width, 3 * k + 1), layer(width, width, 3 * k + 2)]}]
        size = width
    return [*parts, {"output": layer(size, 1, 9, norm=False)}]
