"""Cleaning: rename, drop, median/mode imputation, log scaling.

Imputation follows Spark ML's estimator / model split: *fit* is one
aggregate job over an explicit fit set that yields one row of parameters
(one value per column, whatever the data size); the row is fetched once and
*transform* is a map-only projection with those values as literals.  Row
data never passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import read_once
from .running import quantiles_wide

LOG_COLS_DEFAULT = config.LOG_TRANSFORM_COLS


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by map; keys that are not columns are ignored."""
    mapping = config.RENAME_MAP if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Drop columns; absent ones are ignored unless ``strict``."""
    columns = config.DROP_COLS if columns is None else columns
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*[c for c in columns if c in df.columns])


def present(df: DataFrame, columns: list[str], strict: bool = False) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    return [c for c in columns if c in df.columns]


def long_values(df: DataFrame, columns: list[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``columns`` into (column, value)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value")) for c in columns
    ])).alias("_kv")).select("_kv.column", "_kv.value")


def fit_medians(fit_df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """One row, one column per input column: the median of its non-null values.

    Exact by default (distributed selection, no per-task value buffer);
    ``approx=True`` uses the one-pass bounded sketch.
    """
    q = quantiles_wide(long_values(fit_df, columns), ["column"], "value", {"median": 0.5}, approx=approx, small=True)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns])


def fit_modes(fit_df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: most frequent non-null value per column, ties to the smallest value."""
    counts = (long_values(fit_df, columns, "string").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    # min over (-n, value): highest count first, then the smallest value; a
    # plain partial aggregate, so no per-column task ever sees all levels.
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
                                        .alias("m"))
    return best.agg(*[F.max(F.when(F.col("column") == c, F.col("m.v"))).alias(c) for c in columns])


def fit_imputers(fit_df: DataFrame, numeric: list[str], categorical: list[str], approx: bool = False) -> tuple[dict, dict]:
    """(medians, modes), the same way at every size; no buffer holds a column's values."""
    medians = params_of(fit_medians(fit_df, numeric, approx)) if numeric else {}
    modes = params_of(fit_modes(fit_df, categorical)) if categorical else {}
    return medians, modes


def params_of(params: DataFrame) -> dict:
    """Fetch a one-row parameter table (size bounded by the column count)."""
    row = params.first()
    return row.asDict() if row is not None else {}


def apply_fill(df: DataFrame, values: dict, columns: list[str]) -> DataFrame:
    """coalesce(column, fitted value); a column with no fitted value stays as is."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(values[c]).cast(df.schema[c].dataType))
                           for c in columns if values.get(c) is not None})


def impute_median(df: DataFrame, columns: list[str] | None = None, fit_df: DataFrame | None = None,
                  approx: bool = False) -> DataFrame:
    cols = present(df, config.NUMERIC_COLS if columns is None else columns)
    if not cols:
        return df
    with read_once((fit_df if fit_df is not None else df).select(*cols)) as kept:
        medians = params_of(fit_medians(kept, cols, approx))
    return apply_fill(df, medians, cols)


def impute_mode(df: DataFrame, columns: list[str] | None = None, fit_df: DataFrame | None = None,
                strict: bool = True) -> DataFrame:
    cols = present(df, config.CATEGORICAL_COLS if columns is None else columns, strict=strict)
    if not cols:
        return df
    return apply_fill(df, params_of(fit_modes(fit_df if fit_df is not None else df, cols)), cols)


def log_transform(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """log1p on the listed columns that exist (NULL where log1p is undefined)."""
    cols = present(df, config.LOG_TRANSFORM_COLS if columns is None else columns)
    return df.withColumns({c: F.log1p(F.col(c)) for c in cols})


def clean_data(raw: DataFrame, categoricals: list[str] | None = None, fit_filter=None,
               approx: bool = False) -> DataFrame:
    """rename -> drop -> impute (median / mode) -> log1p.

    ``fit_filter`` restricts the rows the imputers are fitted on (for example
    the training split); by default they are fitted on the whole table.  The
    fits' columns are read once and released before the transform.
    """
    df = drop_columns(rename_columns(raw))
    fit_df = df.where(fit_filter) if fit_filter is not None else df
    nums = present(df, config.NUMERIC_COLS)
    cats = present(df, config.CATEGORICAL_COLS if categoricals is None else categoricals, strict=True)
    with read_once(fit_df.select(*nums, *cats)) as kept:
        medians, modes = fit_imputers(kept, nums, cats, approx)
    return log_transform(apply_fill(apply_fill(df, medians, nums), modes, cats))
