"""Deterministic per-row uniform numbers.

Spark's ``rand`` depends on partitioning, so splits, candidate generation and
synthetic draws use a keyed digest instead: the first 52 bits of the MD5 of
``key|...|salt``, as a number in [0, 1).  Keys are text inside the digest, so no
key is too large, composite keys are lists rather than products, and draws of
different salts are independent.  Both engines produce identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
RANGE = 1 << 4 * HEX_DIGITS


def unit_hash(key: Column | str | list, salt: int) -> Column:
    """u in [0, 1) from whole-number keys (one, or a list) and an integer salt; NULL for a NULL key."""
    parts = []
    for k in key if isinstance(key, list) else [key]:
        parts += [(F.col(k) if isinstance(k, str) else k).cast("bigint").cast("string"), F.lit("|")]
    digest = F.md5(F.concat(*parts, F.lit(str(int(salt)))))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(RANGE))


def unit_hash_sql(key_sql: str | list[str], salt: int) -> str:
    """The same number as DuckDB SQL text."""
    keys = key_sql if isinstance(key_sql, list) else [key_sql]
    text = " || '|' || ".join(f"CAST(CAST({k} AS BIGINT) AS VARCHAR)" for k in keys)
    return (f"(CAST(CAST('0x' || substr(md5({text} || '|{int(salt)}'), 1, {HEX_DIGITS}) AS BIGINT) AS DOUBLE)"
            f" / CAST({RANGE} AS DOUBLE))")
