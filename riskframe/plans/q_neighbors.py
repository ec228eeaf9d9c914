"""Registered queries: nearest minority neighbours and SMOTE oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash_sql
from ..operators import features, neighbors, pivots
from ..session import cut_lineage, through_files
from . import common
from .q_explain import ONE_HOT
from .registry import query
from .sql_views import q, register, with_views

KNN_FEATURES = ["loan_amount", "ltv", "dtir1"]
K = 5
SALT = 50


def _minority_and_majority(spark, sf):
    p = features.prepared(common.raw(spark, sf)).where(F.col("dataset") == "train")
    counts = {r.status: r["count"] for r in p.groupBy("status").count().collect()}
    minority_label = min(counts, key=lambda s: (counts[s], s))
    majority = max(counts.values())
    return p.where(F.col("status") == minority_label).select("id", *KNN_FEATURES), majority


_MULTS = neighbors.PERMUTATION_MULTIPLIERS
_A = "CASE " + " ".join(f"WHEN GCD(n_min, {m}) = 1 THEN {m}" for m in _MULTS) + " ELSE 1 END"
_KEY = ["s.base_id", "s.sample"]


def _register(end: str, source: str, feats: list[str]) -> None:
    """The views minority, knn, smote_params and smote_rows over ``feats`` of ``source``, named with ``end``."""
    cols = ", ".join(map(q, feats))
    dist = " + ".join(f"POWER(a.{q(f)} - b.{q(f)}, 2)" for f in feats)
    register(f"minority{end}", f"""
SELECT id, {cols} FROM {source} WHERE dataset = 'train' AND status = (
  SELECT status FROM (SELECT status, COUNT(*) AS n FROM {source} WHERE dataset = 'train' GROUP BY status)
  ORDER BY n, status LIMIT 1)""", [source])
    register(f"knn{end}", f"""
SELECT id, CAST(rank AS INT) AS rank, neighbor_id, distance FROM (
  SELECT id, neighbor_id, distance, ROW_NUMBER() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS rank FROM (
    SELECT a.id, b.id AS neighbor_id, SQRT({dist}) AS distance
    FROM minority{end} a JOIN minority{end} b ON a.id <> b.id))
WHERE rank <= {K}""", [f"minority{end}"])
    register(f"smote_params{end}", f"""
SELECT n_min, n_maj - n_min AS need, (n_maj - n_min) // n_min AS q, (n_maj - n_min) % n_min AS rem, {_A} AS a
FROM (SELECT (SELECT COUNT(*) FROM minority{end}) AS n_min,
             (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {source} WHERE dataset = 'train' GROUP BY status)) AS n_maj)
""", [f"minority{end}", source])
    register(f"smote_rows{end}", f"""
WITH alloc AS (
  SELECT m.id AS base_id, p.q + CASE WHEN ((ROW_NUMBER() OVER (ORDER BY m.id) - 1) * p.a) % p.n_min < p.rem
                                    THEN 1 ELSE 0 END AS cnt
  FROM minority{end} m, smote_params{end} p),
kk AS (SELECT id AS base_id, MAX(rank) AS kk FROM knn{end} GROUP BY id),
samples AS (
  SELECT a.base_id, CAST(g.sample AS INT) AS sample, k.kk
  FROM alloc a JOIN kk k ON a.base_id = k.base_id, range(0, 1000000) g(sample) WHERE g.sample < a.cnt),
picked AS (
  SELECT s.base_id, s.sample, CAST(FLOOR({unit_hash_sql(_KEY, SALT + 1)} * s.kk) + 1 AS INT) AS rank,
         {unit_hash_sql(_KEY, SALT + 2)} AS step
  FROM samples s, smote_params{end} p)
SELECT pk.base_id, pk.sample, n.neighbor_id, pk.step,
       {", ".join(f"x.{q(f)} + pk.step * (y.{q(f)} - x.{q(f)}) AS {q(f)}" for f in feats)}
FROM picked pk JOIN knn{end} n ON pk.base_id = n.id AND pk.rank = n.rank
JOIN minority{end} x ON x.id = pk.base_id JOIN minority{end} y ON y.id = n.neighbor_id
""", [f"minority{end}", f"knn{end}", f"smote_params{end}"])


_register("", "prepared", KNN_FEATURES)

ENCODED = [*config.SCALED_COLS, *[f"{c}_{v}" for c, v in ONE_HOT]]
register("encoded", "SELECT id, dataset, status, " + ", ".join(config.SCALED_COLS) + ", " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {q(f'{c}_{v}')}" for c, v in ONE_HOT) + " FROM prepared", ["prepared"])
_register("_encoded", "encoded", ENCODED)


@query("knn_minority", with_views("SELECT * FROM knn", "knn"), ["distance"])
def knn_minority(spark, sf):
    """H4: exact 5 nearest minority neighbours (training rows, standardised features), block index."""
    minority, _ = _minority_and_majority(spark, sf)
    return neighbors.knn(minority, KNN_FEATURES, K)


@query("smote", with_views("SELECT * FROM smote_rows", "smote_rows"), ["step", *KNN_FEATURES])
def smote(spark, sf):
    """H4: synthetic minority rows until the training classes are 1:1."""
    minority, n_major = _minority_and_majority(spark, sf)
    return neighbors.smote(minority, KNN_FEATURES, n_major, K, salt=SALT)


def _encoded_minority(spark, sf):
    p = through_files(features.prepared_encoded(common.raw(spark, sf), config.FIXTURE_CATEGORICALS, keep=["id", "dataset", "status", *config.SCALED_COLS])
                      .where(F.col("dataset") == "train"), "encoded-train")
    counts = {r.status: r["count"] for r in p.groupBy("status").count().collect()}
    label = min(counts, key=lambda s: (counts[s], s))
    return p.where(F.col("status") == label).select("id", *ENCODED), max(counts.values())


@query("knn_encoded", with_views("SELECT * FROM knn_encoded", "knn_encoded"), ["distance"])
def knn_encoded(spark, sf):
    """H4: exact 5 nearest minority neighbours over the whole encoded training table, pivot index."""
    return pivots.knn(_encoded_minority(spark, sf)[0], ENCODED, K)


@query("smote_encoded", with_views("SELECT * FROM smote_rows_encoded", "smote_rows_encoded"), ["step", *ENCODED])
def smote_encoded(spark, sf):
    """H4: the encoded training table oversampled until its classes are 1:1."""
    minority, n_major = _encoded_minority(spark, sf)
    return neighbors.smote(minority, ENCODED, n_major, K, salt=SALT, neighbors=cut_lineage(pivots.knn(minority, ENCODED, K)))
