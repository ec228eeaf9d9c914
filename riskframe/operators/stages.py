"""The preparation as Spark ML stages, so that one saved ``PipelineModel`` scores raw rows.

Each fitted stage holds a few numbers or names a column (its parameters are its
whole state), so Spark ML's own writer saves it as metadata and the pipeline's
writer puts preparation and classifier into one folder.  ``transform`` is a map
over rows throughout: the loaded model works on batch and streaming frames.
Estimators fit on the rows that ``fitCondition`` names, every row if it is empty.
"""

from __future__ import annotations

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import cleaning, features

TRAIN = "dataset = 'train'"


def _param(name: str, doc: str, convert=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters by keyword; saved and read by Spark ML's metadata writer."""

    def _take(self, values: dict):
        self._set(**{k: v for k, v in values.items() if v is not None})
        return self

    def value(self, name: str):
        return self.getOrDefault(name)


class _Fitted(_Saved, Estimator):
    fitCondition = _param("fitCondition", "SQL condition of the rows to fit on", TypeConverters.toString)

    def rows(self, df: DataFrame) -> DataFrame:
        condition = self.value("fitCondition") if self.isSet("fitCondition") else ""
        return df.where(condition) if condition else df


class ShapeRaw(_Saved, Transformer):
    """Raw names to workflow names, dropped columns, and the split's ``dataset``."""

    renames = _param("renames", "raw column name to name")
    drops = _param("drops", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, renames=None, drops=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df):
        return features.with_split(cleaning.drop_columns(cleaning.rename_columns(df, self.value("renames")), self.value("drops")))


class FillMissing(_Fitted):
    """Medians of numeric and modes of categorical columns."""

    numeric = _param("numeric", "columns filled with their median", TypeConverters.toListString)
    categorical = _param("categorical", "columns filled with their mode", TypeConverters.toListString)

    @keyword_only
    def __init__(self, numeric=None, categorical=None, fitCondition=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _fit(self, df):
        medians, modes = cleaning.fit_imputers(self.rows(df), self.value("numeric"), self.value("categorical"))
        return FillMissingModel(values=medians | modes)


class FillMissingModel(_Saved, Model):
    values = _param("values", "column to fill value")

    @keyword_only
    def __init__(self, values=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df):
        filled = self.value("values")
        return cleaning.apply_fill(df, filled, [c for c in filled if c in df.columns])


class LogScale(_Saved, Transformer):
    """log1p of the listed columns."""

    columns = _param("columns", "columns to scale", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df):
        return cleaning.log_transform(df, self.value("columns"))


class Standardize(_Fitted):
    """(x - mean) / population standard deviation."""

    columns = _param("columns", "columns to standardise", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns=None, fitCondition=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _fit(self, df):
        columns = self.value("columns")
        cast = self.rows(df).select(*[F.col(c).cast("double").alias(c) for c in columns])
        p = cleaning.params_of(features.fit_scaler(cast, columns))
        scale = {c: [float(p[f"{c}__mean"]), float(p[f"{c}__std"] or 1.0)] for c in columns if p[f"{c}__mean"] is not None}
        return StandardizeModel(columns=columns, scale=scale)


class StandardizeModel(_Saved, Model):
    columns = _param("columns", "columns to standardise", TypeConverters.toListString)
    scale = _param("scale", "column to mean and deviation")

    @keyword_only
    def __init__(self, columns=None, scale=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df):
        scale = self.value("scale")
        x = {c: F.col(c).cast("double") for c in self.value("columns")}
        return df.withColumns({c: (e - F.lit(scale[c][0])) / F.lit(scale[c][1]) if c in scale else e for c, e in x.items()})


class EncodeLevels(_Fitted):
    """One 0/1 column a level of each categorical, and a vector of these behind the numeric ones."""

    categorical = _param("categorical", "columns to encode", TypeConverters.toListString)
    numeric = _param("numeric", "columns put before them in the vector", TypeConverters.toListString)
    maxLevels = _param("maxLevels", "levels of a column beyond which fitting fails", TypeConverters.toInt)

    @keyword_only
    def __init__(self, categorical=None, numeric=None, fitCondition=None, maxLevels=10_000):
        super().__init__()
        self._take(self._input_kwargs | {"maxLevels": maxLevels})

    def _fit(self, df):
        columns = self.value("categorical")
        levels = features.known_levels(self.rows(df), columns, self.value("maxLevels"))
        return EncodeLevelsModel(levels=levels, numeric=self.value("numeric"))


class EncodeLevelsModel(_Saved, Model):
    levels = _param("levels", "column to its levels in order")
    numeric = _param("numeric", "columns put before them in the vector", TypeConverters.toListString)

    @keyword_only
    def __init__(self, levels=None, numeric=None):
        super().__init__()
        self._take(self._input_kwargs)

    @property
    def names(self) -> list[str]:
        """Names of the vector's entries."""
        known = self.value("levels")
        return [*self.value("numeric"), *features.encoded_names(list(known), known)]

    def _transform(self, df):
        known = self.value("levels")
        encoded = features.one_hot(df, list(known), levels=known, keep=df.columns)
        return VectorAssembler(inputCols=self.names, outputCol="features", handleInvalid="error").transform(encoded)


class PenalisedLogistic(_Fitted):
    """L2 logistic regression with scikit-learn's C on the rows of ``fitCondition``; its model is Spark ML's."""

    label = _param("label", "label column", TypeConverters.toString)
    C = _param("C", "inverse strength of the penalty", TypeConverters.toFloat)
    maxIter = _param("maxIter", "most iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, label=config.TARGET_COL, C=100.0, maxIter=1000, fitCondition=None):
        super().__init__()
        self._take({"label": label, "C": C, "maxIter": maxIter} | self._input_kwargs)

    def _fit(self, df):
        label = self.value("label")
        rows = self.rows(df).select(F.col(label).cast("double").alias(label), "features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            reg = 1.0 / (self.value("C") * max(rows.count(), 1))
            return LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False,
                                      maxIter=self.value("maxIter"), tol=1e-8).fit(rows)
        finally:
            rows.unpersist()


class Decide(_Saved, Transformer):
    """predicted_probability of class 1 and predicted_label at the threshold; the model's other columns go."""

    threshold = _param("threshold", "probability from which the label is 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, threshold=config.DECISION_THRESHOLD):
        super().__init__()
        self._take({"threshold": threshold} | self._input_kwargs)

    def _transform(self, df):
        p = df.withColumn("predicted_probability", vector_to_array("probability")[1])
        p = p.withColumn("predicted_label", (F.col("predicted_probability") >= self.value("threshold")).cast("int"))
        return p.drop("features", "rawPrediction", "probability", "prediction")


def application_pipeline(numeric: list[str] | None = None, categorical: list[str] | None = None, scaled: list[str] | None = None,
                         condition: str = TRAIN, C: float = 100.0) -> Pipeline:
    """Raw application rows to probabilities: shape, fill, log, standardise, encode, classify, decide."""
    numeric = config.NUMERIC_COLS if numeric is None else numeric
    categorical = config.FIXTURE_CATEGORICALS if categorical is None else categorical
    scaled = config.SCALED_COLS if scaled is None else scaled
    return Pipeline(stages=[
        ShapeRaw(renames=dict(config.RENAME_MAP), drops=list(config.DROP_COLS)),
        FillMissing(numeric=numeric, categorical=categorical, fitCondition=condition),
        LogScale(columns=list(config.LOG_TRANSFORM_COLS)),
        Standardize(columns=scaled, fitCondition=condition),
        EncodeLevels(categorical=categorical, numeric=scaled, fitCondition=condition),
        PenalisedLogistic(C=C, fitCondition=condition),
        Decide(),
    ])


def fit_application_model(raw: DataFrame, **settings) -> PipelineModel:
    """The pipeline fitted on a batch raw table, which is read once."""
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return application_pipeline(**settings).fit(raw)
    finally:
        raw.unpersist()


def feature_names(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, EncodeLevelsModel)).names
