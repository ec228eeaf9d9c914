"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import round_sql, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CHECK: dict[str, str] = {}


def query(name: str, sql: str | None = None, round_cols: list[str] | None = None, check: str = "E"):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``round_cols`` names the measures that both sides round to 6 dp; all other
    columns must agree exactly.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), round_cols or [])
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        CHECK[name] = check
        if sql is not None:
            ORACLE[name] = round_sql(sql, round_cols or [])
        return fn
    return deco
