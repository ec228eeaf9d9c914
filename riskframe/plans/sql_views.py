"""SQL text of the fixture views and shared stages, for the DuckDB oracle.

Each oracle query inlines what it needs as WITH clauses, because only the
base tables are registered on the oracle side.  The Spark side builds the
same views with the DataFrame API (``riskframe.sources.tables``).
"""

from __future__ import annotations

from .. import config
from ..functions.hashing import unit_hash_sql
from ..operators.metrics import calibration_edges


def U(salt: int, key: str = "o_orderkey") -> str:
    return unit_hash_sql(key, salt)


def q(name: str) -> str:
    """Quote an identifier."""
    return '"' + name.replace('"', '""') + '"'


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


RAW = f"""
SELECT CAST(o_orderkey AS BIGINT) AS ID, CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN {U(10)}<0.02 THEN NULL WHEN {U(11)}<0.3 THEN 'Male' WHEN {U(11)}<0.55 THEN 'Joint'
       WHEN {U(11)}<0.75 THEN 'Female' ELSE 'Sex Not Available' END AS Gender,
  CASE WHEN {U(8)}<0.02 THEN NULL ELSE o_orderpriority END AS loan_type,
  o_orderstatus AS credit_type, c_mktsegment AS Region,
  CASE WHEN {U(12)}<0.1 THEN '<25' WHEN {U(12)}<0.5 THEN '25-34' WHEN {U(12)}<0.9 THEN '35-44' ELSE '>74' END AS age,
  CAST(o_totalprice AS DOUBLE) AS loan_amount,
  CASE WHEN {U(1)}<0.27 THEN NULL ELSE CAST(ROUND(CAST(2.0 AS DOUBLE)+{U(2)}*3,3) AS DOUBLE) END AS rate_of_interest,
  CASE WHEN c_acctbal<0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS income,
  CAST(500+FLOOR({U(5)}*401) AS DOUBLE) AS Credit_Score,
  CASE WHEN {U(1)}<0.1 THEN NULL ELSE CAST(ROUND(100/(1+{U(2)}),2) AS DOUBLE) END AS LTV,
  CASE WHEN {U(1)}<0.1 THEN NULL ELSE CAST(ROUND(o_totalprice*(1+{U(2)}),2) AS DOUBLE) END AS property_value,
  CASE WHEN {U(3)}<0.01 THEN NULL ELSE CAST(96+12*FLOOR({U(4)}*23) AS DOUBLE) END AS term,
  CASE WHEN {U(6)}<0.16 THEN NULL ELSE CAST(5+FLOOR({U(7)}*57) AS DOUBLE) END AS dtir1,
  CASE WHEN {U(9)} < CAST(0.1 AS DOUBLE)+{U(7)}/4+{U(4)}/10 THEN 1 ELSE 0 END AS Status
FROM orders JOIN customer ON o_custkey=c_custkey
"""

V = lambda s: unit_hash_sql("ID", s)

PREDICTIONS = f"""
SELECT ID AS id, Status AS true_label,
  CASE WHEN {V(21)}<0.8 THEN 'train' WHEN {V(21)}<0.9 THEN 'validation' ELSE 'test' END AS dataset,
  (COALESCE(dtir1,33)/66+{V(22)})/2 AS p_a,
  CAST(ROUND((COALESCE(dtir1,33)/66+{V(23)}*3)/4,2) AS DOUBLE) AS p_b
FROM raw_applications
"""

PRED_LONG = """
SELECT id, 'a' AS model, dataset, true_label AS y, p_a AS p FROM predictions
UNION ALL
SELECT id, 'b' AS model, dataset, true_label AS y, p_b AS p FROM predictions
"""

RENAMED = """
SELECT ID AS id, year, Gender AS gender, loan_type, credit_type, Region AS region, age, loan_amount,
  rate_of_interest, income, Credit_Score AS credit_score, LTV AS ltv, property_value, term, dtir1,
  Status AS status
FROM raw_applications
"""

DROPPED = """
SELECT id, year, gender, loan_type, credit_type, region, age, loan_amount, income, credit_score, ltv,
  property_value, term, dtir1, status
FROM renamed
"""

NUM = config.NUMERIC_COLS
CAT = config.FIXTURE_CATEGORICALS
LOG = config.LOG_TRANSFORM_COLS


def _medians(src: str, where: str = "") -> str:
    cols = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUM)
    return f"SELECT {cols} FROM {src} {where}"


def _modes(src: str, where: str = "") -> str:
    w = f"{where} AND" if where else "WHERE"
    parts = []
    for c in CAT:
        parts.append(f"(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n FROM {src} {w} {c} IS NOT NULL "
                     f"GROUP BY {c}) ORDER BY n DESC, v LIMIT 1) AS {c}")
    return "SELECT " + ", ".join(parts)


def _cleaned(src: str, med: str, mod: str, extra: str = "") -> str:
    cols = ["id", "year"]
    for c in CAT:
        cols.append(f"COALESCE({c}, (SELECT {c} FROM {mod})) AS {c}")
    for c in ["loan_amount", "income", "credit_score", "ltv", "property_value", "term", "dtir1"]:
        e = f"COALESCE({c}, (SELECT {c} FROM {med}))"
        cols.append(f"LN(1 + {e}) AS {c}" if c in LOG else f"{e} AS {c}")
    cols.append("status")
    if extra:
        cols.append(extra)
    return f"SELECT {', '.join(cols)} FROM {src}"


SPLIT = f"""
SELECT *, CASE WHEN {V(21).replace('ID', 'id')}<0.8 THEN 'train'
               WHEN {V(21).replace('ID', 'id')}<0.9 THEN 'validation' ELSE 'test' END AS dataset
FROM dropped
"""

SCALED = config.SCALED_COLS


def _scaler(src: str) -> str:
    cols = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS {c}__mean, STDDEV_POP(CAST({c} AS DOUBLE)) AS {c}__std"
                     for c in SCALED)
    return f"SELECT {cols} FROM {src} WHERE dataset = 'train'"


def _standardized(src: str, params: str) -> str:
    cols = ["id", "dataset", "status"]
    for c in SCALED:
        cols.append(f"(CAST({c} AS DOUBLE) - (SELECT {c}__mean FROM {params})) / "
                    f"(SELECT CASE WHEN {c}__std = 0 THEN CAST(1 AS DOUBLE) ELSE {c}__std END FROM {params}) AS {c}")
    cols += CAT
    return f"SELECT {', '.join(cols)} FROM {src}"


CTES: dict[str, tuple[str, list[str]]] = {
    "raw_applications": (RAW, []),
    "predictions": (PREDICTIONS, ["raw_applications"]),
    "pred_long": (PRED_LONG, ["predictions"]),
    "renamed": (RENAMED, ["raw_applications"]),
    "dropped": (DROPPED, ["renamed"]),
    "medians_all": (_medians("dropped"), ["dropped"]),
    "modes_all": (_modes("dropped"), ["dropped"]),
    "cleaned": (_cleaned("dropped", "medians_all", "modes_all"), ["dropped", "medians_all", "modes_all"]),
    "split": (SPLIT, ["dropped"]),
    "medians_train": (_medians("split", "WHERE dataset = 'train'"), ["split"]),
    "modes_train": (_modes("split", "WHERE dataset = 'train'"), ["split"]),
    "cleaned_train_fit": (_cleaned("split", "medians_train", "modes_train", "dataset"),
                          ["split", "medians_train", "modes_train"]),
    "scaler": (_scaler("cleaned_train_fit"), ["cleaned_train_fit"]),
    "prepared": (_standardized("cleaned_train_fit", "scaler"), ["cleaned_train_fit", "scaler"]),
}


def register(name: str, sql: str, deps: list[str]) -> None:
    CTES[name] = (sql, deps)


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the WITH clauses of ``views`` and their dependencies.

    ``extra`` holds query-local CTEs (name -> sql), appended after the views.
    """
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for v in views:
        visit(v)
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body.strip()) if parts else body.strip()


def calibration_bin_sql(col: str = "p", n_bins: int = 10) -> str:
    return "(" + " + ".join(f"(CASE WHEN {col} > {dbl(e)} THEN 1 ELSE 0 END)"
                            for e in calibration_edges(n_bins)) + ")"
