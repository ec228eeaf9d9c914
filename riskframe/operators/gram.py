"""Pairwise-complete moments of many columns by masked block products.

A batch of rows is a matrix X with its mask M of present values.  The products
M'M, X'M, (X*X)'M and X'X hold, for every pair of columns, the count, sums, sums
of squares and sum of products over the rows in which both are present.  Each
task adds its batches' products and returns one row a pair; a sum by pair over
the tasks gives the moments.  So the work is rows by columns in vector form, and
no row is copied for a pair.  Columns are shifted by their overall mean first,
which keeps the differences of sums exact enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
#: Share of a column's squares below which its spread is rounding: a constant column.
FLAT = 1e-12


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of each pair i <= j of column positions, around the columns' means.

    One aggregate gives the means (one number a column); then one pass.  ``df``
    is read twice: keep it if it is costly."""
    c = len(columns)
    wide = df.select(*[F.col(f"`{x}`").cast("double").alias(f"x{i}") for i, x in enumerate(columns)])
    means = wide.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(c)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    a, b = np.triu_indices(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, c, c))
        for batch in batches:
            here = np.column_stack([np.asarray(col.is_valid()) for col in batch.columns]).astype(np.float64)
            x = np.column_stack([col.fill_null(0.0).to_numpy(zero_copy_only=False) for col in batch.columns])
            x = np.where(here > 0, x - shift, 0.0)
            sums, squares = x.T @ here, (x * x).T @ here
            total += np.stack([here.T @ here, sums, sums.T, squares, squares.T, x.T @ x])
        if total[0].any():
            cols = [total[m][a, b] for m in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(cols[0].astype(np.int64)), *map(pa.array, cols[1:])],
                                             names=["i", "j", *MOMENTS])

    parts = wide.mapInArrow(run, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlations(moments: DataFrame, columns: list[str]) -> DataFrame:
    """(row_feature, col_feature, corr) of every ordered pair; NULL where a column is constant over the pair's rows."""
    n = F.col("n").cast("double")

    def spread(s: str, ss: str):
        v = n * F.col(ss) - F.col(s) * F.col(s)
        return F.when(~F.isnan(v) & (v <= F.lit(FLAT) * n * F.col(ss)), F.lit(0.0)).otherwise(v)

    corr = F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")))
    names = F.array(*[F.lit(c) for c in columns])
    upper = moments.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), corr.alias("corr"))
    both = F.array(F.struct(F.col("a").alias("row_feature"), F.col("b").alias("col_feature"), "corr"),
                   F.struct(F.col("b").alias("row_feature"), F.col("a").alias("col_feature"), "corr"))
    return upper.select(F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))
