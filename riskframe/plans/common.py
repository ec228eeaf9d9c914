"""Shared plumbing for registered queries: rounding and cached per-run views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

DP = 6


def rounded(df: DataFrame, cols: list[str], dp: int = DP) -> DataFrame:
    """Round the named measures (both engines sum in different orders); keys and thresholds stay exact."""
    return df.withColumns({c: F.round(F.col(c), dp) for c in cols}) if cols else df


def round_sql(sql: str, cols: list[str], dp: int = DP) -> str:
    """Wrap an oracle query so the named double columns are rounded like the Spark side."""
    if not cols:
        return sql
    rep = ", ".join(f'ROUND("{c}", {dp}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _r"


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return tables.raw_applications(spark, sf)


def pred_long(spark: SparkSession, sf: str) -> DataFrame:
    return tables.predictions_long(spark, sf)
