"""Compare a registered query with its DuckDB oracle (names, row count, values)."""

from __future__ import annotations

import math
import os

import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return "NULL"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(v + 0.0)
    return str(v)


def normalized(pdf) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False))


def compare(spark_pdf, oracle_pdf) -> tuple[bool, str]:
    for c in set(spark_pdf.columns) & set(oracle_pdf.columns):
        if str(oracle_pdf[c].dtype) == "Int64" and spark_pdf[c].isna().any():     # whole numbers with nulls
            spark_pdf = spark_pdf.assign(**{c: spark_pdf[c].astype("Int64")})
    sc, sr = normalized(spark_pdf)
    oc, orows = normalized(oracle_pdf)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orows):
        return False, f"row counts differ: spark={len(sr)} oracle={len(orows)}"
    if sr != orows:
        ss, os_ = set(sr), set(orows)
        return False, f"values differ: only spark {sorted(ss - os_)[:2]} only oracle {sorted(os_ - ss)[:2]}"
    return True, "ok"
