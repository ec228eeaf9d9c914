"""Registered queries: profiling and exploratory tables."""

from __future__ import annotations

import math

from .. import config
from ..operators import cleaning, features, profile
from . import common
from .q_metrics import histogram_sql
from .q_neighbors import ENCODED
from .registry import query
from .sql_views import dbl, q, register, with_views

DESCRIBE_COLS = ["id", "year", "loan_amount", "rate_of_interest", "income", "credit_score", "ltv", "property_value",
                 "term", "dtir1", "status"]
MEASURES = ["loan_amount", "rate_of_interest", "income", "credit_score", "ltv", "property_value", "term", "dtir1"]
CORR_COLS = MEASURES + ["status"]
CATS = config.FIXTURE_CATEGORICALS
TARGETS = ["status", "property_value", "income", "loan_amount", "rate_of_interest", "term", "ltv"]
PAIRS = [("rate_of_interest", "ltv"), ("loan_amount", "property_value"), ("income", "dtir1")]
RENAMED_TYPES = [("id", "bigint"), ("year", "int"), ("gender", "string"), ("loan_type", "string"),
                 ("credit_type", "string"), ("region", "string"), ("age", "string"), ("loan_amount", "double"),
                 ("rate_of_interest", "double"), ("income", "double"), ("credit_score", "double"), ("ltv", "double"),
                 ("property_value", "double"), ("term", "double"), ("dtir1", "double"), ("status", "int")]


def _long_sql(cols, typ="DOUBLE"):
    return "\nUNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS {typ}) AS value FROM renamed" for c in cols)


register("num_long", _long_sql(DESCRIBE_COLS), ["renamed"])
register("measure_long", _long_sql(MEASURES), ["renamed"])
register("cat_long", _long_sql(CATS, "VARCHAR"), ["renamed"])
register("cat_counts", "SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS count FROM cat_long "
                       "WHERE value IS NOT NULL GROUP BY feature, value", ["cat_long"])


def _renamed(spark, sf):
    return cleaning.rename_columns(common.raw(spark, sf))


@query("describe_numeric", with_views("""
SELECT feature, CAST(COUNT(value) AS BIGINT) AS count, AVG(value) AS mean, STDDEV_SAMP(value) AS std,
       MIN(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, MAX(value) AS max
FROM num_long GROUP BY feature""", "num_long"), ["mean", "std", "min", "q25", "q50", "q75", "max"])
def describe_numeric(spark, sf):
    """Count, mean, std, min, quartiles (exact, linear), max per numeric column."""
    return profile.describe_numeric(_renamed(spark, sf), DESCRIBE_COLS)


@query("value_counts", with_views("""
SELECT feature, value, count,
       CAST(count AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(SUM(count) OVER (PARTITION BY feature) AS DOUBLE) AS percent
FROM cat_counts""", "cat_counts"), ["percent"])
def value_counts(spark, sf):
    """C4: frequency and share of each level, missing values excluded."""
    return profile.value_counts(_renamed(spark, sf), CATS)


@query("top_categories", with_views("""
SELECT feature, value, count, rank FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY count DESC, value) AS INT) AS rank FROM cat_counts)
WHERE rank <= 20""", "cat_counts"))
def top_categories(spark, sf):
    """Top-20 levels of each categorical column (two-round salted top-k)."""
    return profile.top_categories(_renamed(spark, sf), CATS, 20)


def _missing_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS missing_count, "
             f"ROUND(CAST(COUNT_IF({c} IS NULL) AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE), 2) AS missing_percent "
             f"FROM renamed" for c, _ in RENAMED_TYPES]
    return with_views("\nUNION ALL ".join(parts), "renamed")


@query("missing_profile", _missing_sql())
def missing_profile(spark, sf):
    """Missing count and percent (2 dp) per column."""
    return profile.missing_profile(_renamed(spark, sf))


@query("missing_patterns", with_views(
    "SELECT CONCAT(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c, _ in RENAMED_TYPES)
    + ") AS pattern, CAST(COUNT(*) AS BIGINT) AS count FROM renamed GROUP BY 1", "renamed"))
def missing_patterns(spark, sf):
    """Rows per combination of missing columns (the null heatmap as a table)."""
    return profile.missing_patterns(_renamed(spark, sf))


@query("table_overview", with_views("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, '{t}' AS data_type, CAST(COUNT({c}) AS BIGINT) AS non_null, "
    f"CAST(COUNT(*) AS BIGINT) AS rows FROM renamed" for i, (c, t) in enumerate(RENAMED_TYPES)), "renamed"))
def table_overview(spark, sf):
    """Columns, types, non-null counts and row count."""
    return profile.table_overview(_renamed(spark, sf))


def _corr_sql():
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs.append(f"COVAR_POP({a}, {b}) / NULLIF(SQRT(VAR_POP(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                    f"VAR_POP(CASE WHEN {a} IS NOT NULL THEN {b} END)), 0) AS _{i}")
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(f"SELECT '{a}' AS row_feature, '{b}' AS col_feature, _{i} AS corr FROM w")
        if a != b:
            rows.append(f"SELECT '{b}' AS row_feature, '{a}' AS col_feature, _{i} AS corr FROM w")
    src = "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CORR_COLS) + " FROM renamed"
    return f"SELECT {', '.join(aggs)} FROM ({src})", "\nUNION ALL ".join(rows)


_W, _CORR_ROWS = _corr_sql()
register("corr_w", _W, ["renamed"])
register("corr_long", _CORR_ROWS.replace("FROM w", "FROM corr_w"), ["corr_w"])


@query("correlation_matrix", with_views("SELECT * FROM corr_long", "corr_long"), ["corr"])
def correlation_matrix(spark, sf):
    """Pairwise-complete Pearson matrix (long form), NULL for constant columns."""
    return profile.correlation_matrix(_renamed(spark, sf), CORR_COLS)


def _encoded_corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(ENCODED) for b in ENCODED[i:]]
    wide = "SELECT " + ", ".join(f"CORR({q(a)}, {q(b)}) AS _{i}" for i, (a, b) in enumerate(pairs)) + " FROM encoded"
    rows = [f"{{'a': '{a}', 'b': '{b}', 'c': _{i}}}" for i, (a, b) in enumerate(pairs)]
    rows += [f"{{'a': '{b}', 'b': '{a}', 'c': _{i}}}" for i, (a, b) in enumerate(pairs) if a != b]
    return f"""
SELECT r.a AS row_feature, r.b AS col_feature, CASE WHEN isnan(r.c) THEN NULL ELSE r.c END AS corr
FROM (SELECT unnest([{', '.join(rows)}]) AS r FROM ({wide}))"""


@query("correlation_encoded", with_views(_encoded_corr_sql(), "encoded"), ["corr"])
def correlation_encoded(spark, sf):
    """The matrix over every encoded feature, by masked block products."""
    enc = features.prepared_encoded(common.raw(spark, sf), config.FIXTURE_CATEGORICALS, keep=config.SCALED_COLS)
    return profile.correlation_matrix(enc, ENCODED)


@query("target_correlation", with_views(
    "SELECT col_feature AS target, row_feature AS feature, corr, CAST(ROW_NUMBER() OVER (PARTITION BY col_feature "
    "ORDER BY corr DESC NULLS LAST, row_feature) AS INT) AS rank FROM corr_long WHERE col_feature IN ("
    + ", ".join(f"'{t}'" for t in TARGETS) + ")", "corr_long"), ["corr"])
def target_correlation(spark, sf):
    """C11: correlations with each target, ranked descending."""
    return profile.target_correlation(profile.correlation_matrix(_renamed(spark, sf), CORR_COLS), TARGETS)


@query("histogram_fixed", with_views("SELECT * FROM hfix", "measure_long", extra={
    "hfix": "SELECT * FROM (" + histogram_sql("measure_long", ["feature"], "value", 10) + ")"}), ["bin_lo", "bin_hi"])
def histogram_fixed(spark, sf):
    """10 equal-width bins per numeric column, last bin closed."""
    return profile.histogram_fixed(_renamed(spark, sf), MEASURES, 10)


_AUTO = f"""
WITH st AS (
  SELECT feature, COUNT(*) AS n, MIN(value) AS mn, MAX(value) AS mx,
         quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
  FROM measure_long WHERE value IS NOT NULL GROUP BY feature),
w AS (
  SELECT *, (mx - mn) / (LN(CAST(n AS DOUBLE)) / {dbl(math.log(2.0))} + 1.0) AS sturges,
         2.0 * (q75 - q25) * POWER(CAST(n AS DOUBLE), {dbl(-1.0 / 3.0)}) AS fd FROM st),
s AS (
  SELECT feature,
         CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi,
         CASE WHEN mx = mn THEN 1
              ELSE CAST(CEIL((mx - mn) / (CASE WHEN fd > 0 THEN LEAST(fd, sturges) ELSE sturges END)) AS INT) END AS n_bins
  FROM w),
cnt AS (
  SELECT l.feature, CAST(LEAST(FLOOR((l.value - s.lo) / (s.hi - s.lo) * s.n_bins), s.n_bins - 1) AS INT) AS bin,
         CAST(COUNT(*) AS BIGINT) AS n
  FROM measure_long l JOIN s ON l.feature = s.feature WHERE l.value IS NOT NULL GROUP BY ALL),
grid AS (SELECT feature, lo, hi, n_bins, CAST(b AS INT) AS bin FROM s, range(0, 100000) t(b) WHERE b < n_bins)
SELECT g.feature, g.bin, g.n_bins, g.lo + g.bin * ((g.hi - g.lo) / CAST(g.n_bins AS DOUBLE)) AS bin_lo,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / CAST(g.n_bins AS DOUBLE)) AS bin_hi, COALESCE(c.n, 0) AS count
FROM grid g LEFT JOIN cnt c ON g.feature = c.feature AND g.bin = c.bin
"""


@query("histogram_auto", with_views("SELECT * FROM hauto", "measure_long", extra={
    "hauto": "SELECT * FROM (" + _AUTO + ")"}), ["bin_lo", "bin_hi"])
def histogram_auto(spark, sf):
    """Automatic bin width (min of Freedman-Diaconis and Sturges) per numeric column."""
    return profile.histogram_auto(_renamed(spark, sf), MEASURES)


_GRID, _FINE = 200, 1024
_DENS = f"""
WITH st AS (
  SELECT feature, COUNT(*) AS n, MIN(value) AS mn, MAX(value) AS mx, STDDEV_SAMP(value) AS sd
  FROM measure_long WHERE value IS NOT NULL GROUP BY feature),
w AS (
  SELECT l.feature, CASE WHEN s.mx = s.mn THEN 0
                        ELSE LEAST(FLOOR((l.value - s.mn) / (s.mx - s.mn) * {float(_FINE)}), {_FINE - 1}) END AS b,
         COUNT(*) AS cnt
  FROM measure_long l JOIN st s ON l.feature = s.feature WHERE l.value IS NOT NULL GROUP BY ALL),
c AS (
  SELECT w.feature, w.cnt, s.n, s.sd * POWER(CAST(s.n AS DOUBLE), -0.2) AS h, s.mn, s.mx, s.mx - s.mn AS rng,
         s.mn + (w.b + 0.5) * ((s.mx - s.mn) / {float(_FINE)}) AS ctr
  FROM w JOIN st s ON w.feature = s.feature),
pts AS (
  SELECT feature, CAST(point AS INT) AS point, cnt, n, h, ctr,
         (mn - 0.5 * rng) + point * (2.0 * rng / {float(_GRID - 1)}) AS x
  FROM c, range({_GRID}) t(point))
SELECT feature, point, x, SUM(cnt * EXP(-0.5 * ((x - ctr) / h) * ((x - ctr) / h)))
       / (MAX(n) * MAX(h) * {dbl(math.sqrt(2 * math.pi))}) AS density
FROM pts GROUP BY feature, point, x
"""


@query("density", with_views("SELECT * FROM dens", "measure_long", extra={"dens": "SELECT * FROM (" + _DENS + ")"}),
       ["x", "density"])
def density(spark, sf):
    """Gaussian KDE (Scott bandwidth) on a 200-point grid, linear-binned into 1024 bins."""
    return profile.density(_renamed(spark, sf), MEASURES, _GRID, _FINE)


_BOX = """
WITH q AS (
  SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM measure_long WHERE value IS NOT NULL GROUP BY feature),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.feature, q1, median, q3, iqr, lower_fence, upper_fence,
       MIN(CASE WHEN value >= lower_fence THEN value END) AS whisker_low,
       MAX(CASE WHEN value <= upper_fence THEN value END) AS whisker_high,
       CAST(COUNT_IF(value < lower_fence OR value > upper_fence) AS BIGINT) AS n_outliers
FROM f JOIN measure_long l ON f.feature = l.feature WHERE l.value IS NOT NULL
GROUP BY f.feature, q1, median, q3, iqr, lower_fence, upper_fence
"""


@query("box_stats", with_views("SELECT * FROM box", "measure_long", extra={"box": "SELECT * FROM (" + _BOX + ")"}),
       ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"])
def box_stats(spark, sf):
    """C14: quartiles, 1.5 IQR fences, whiskers and outlier count per numeric column."""
    return profile.box_stats(_renamed(spark, sf), MEASURES)


@query("group_quartiles", with_views("""
SELECT credit_type AS "group", quantile_cont(loan_amount, 0.25) AS q1, quantile_cont(loan_amount, 0.5) AS median,
       quantile_cont(loan_amount, 0.75) AS q3, MIN(loan_amount) AS min, MAX(loan_amount) AS max,
       CAST(COUNT(*) AS BIGINT) AS count
FROM renamed WHERE loan_amount IS NOT NULL GROUP BY credit_type""", "renamed"), ["q1", "median", "q3", "min", "max"])
def group_quartiles(spark, sf):
    """Loan amount quartiles per credit type (violin inner quartiles)."""
    return profile.group_quartiles(_renamed(spark, sf), "credit_type", "loan_amount")


def _grid_sql():
    src = "\nUNION ALL ".join(f"SELECT '{a}|{b}' AS pair, status AS label, CAST({a} AS DOUBLE) AS x, "
                              f"CAST({b} AS DOUBLE) AS y FROM renamed WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                              for a, b in PAIRS)

    def b(v, lo, hi):
        return (f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE LEAST(FLOOR(({v} - {lo}) / ({hi} - {lo}) * 10), 9) END AS INT)")

    return f"""
WITH l AS ({src}),
r AS (SELECT pair, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM l GROUP BY pair)
SELECT l.pair, l.label, {b('x', 'x0', 'x1')} AS bx, {b('y', 'y0', 'y1')} AS by, CAST(COUNT(*) AS BIGINT) AS count
FROM l JOIN r ON l.pair = r.pair GROUP BY ALL
"""


@query("grid_density", with_views("SELECT * FROM gd", "renamed", extra={"gd": "SELECT * FROM (" + _grid_sql() + ")"}))
def grid_density(spark, sf):
    """10 x 10 binned counts per label for three measure pairs (scatter as a table)."""
    return profile.grid_density(_renamed(spark, sf), PAIRS, "status")
