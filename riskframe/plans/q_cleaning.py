"""Registered queries: scans, projections, cleaning."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import unit_hash_sql
from ..operators import cleaning, features
from ..session import cut_lineage
from . import common
from .registry import query
from .sql_views import with_views

CAT = config.FIXTURE_CATEGORICALS
NUM = config.NUMERIC_COLS
RENAMED_COLS = ["id", "year", "gender", "loan_type", "credit_type", "region", "age", "loan_amount",
                "rate_of_interest", "income", "credit_score", "ltv", "property_value", "term", "dtir1", "status"]
DROPPED_COLS = [c for c in RENAMED_COLS if c != "rate_of_interest"]


@query("rename_columns", with_views("SELECT * FROM renamed", "renamed"))
def rename_columns(spark, sf):
    """B1: rename by map, absent keys ignored."""
    return cleaning.rename_columns(common.raw(spark, sf))


@query("drop_columns", with_views("SELECT * FROM dropped", "dropped"))
def drop_columns(spark, sf):
    """B2: drop the configured columns that exist."""
    return cleaning.drop_columns(cleaning.rename_columns(common.raw(spark, sf)))


@query("feature_label_split", with_views(
    f"SELECT {', '.join(c for c in DROPPED_COLS if c != 'status')} FROM dropped", "dropped"))
def feature_label_split(spark, sf):
    """The feature part (everything but the label); the label part is ``select(id, status)``."""
    d = cleaning.drop_columns(cleaning.rename_columns(common.raw(spark, sf)))
    return d.drop(config.TARGET_COL)


@query("select_numeric", with_views(
    "SELECT id, year, loan_amount, rate_of_interest, income, credit_score, ltv, property_value, term, dtir1, "
    "status FROM renamed", "renamed"))
def select_numeric(spark, sf):
    """Numeric columns by schema type."""
    from pyspark.sql.types import NumericType
    d = cleaning.rename_columns(common.raw(spark, sf))
    return d.select(*[f.name for f in d.schema.fields if isinstance(f.dataType, NumericType)])


@query("impute_median", with_views(
    "SELECT id, " + ", ".join(f"COALESCE({c}, (SELECT {c} FROM medians_all)) AS {c}" for c in NUM)
    + " FROM dropped", "dropped", "medians_all"), NUM)
def impute_median(spark, sf):
    """Numeric NULLs replaced by the exact median of the column."""
    d = cleaning.drop_columns(cleaning.rename_columns(common.raw(spark, sf)))
    return cleaning.impute_median(d.select("id", *NUM))


@query("impute_mode", with_views(
    "SELECT id, " + ", ".join(f"COALESCE({c}, (SELECT {c} FROM modes_all)) AS {c}" for c in CAT)
    + " FROM dropped", "dropped", "modes_all"))
def impute_mode(spark, sf):
    """Categorical NULLs replaced by the most frequent level (ties: smallest)."""
    d = cleaning.drop_columns(cleaning.rename_columns(common.raw(spark, sf)))
    return cleaning.impute_mode(d.select("id", *CAT), columns=CAT)


@query("log_transform", with_views("SELECT * FROM cleaned", "cleaned"),
       ["loan_amount", "income", "credit_score", "ltv", "property_value", "term", "dtir1"])
def log_transform(spark, sf):
    """B12 (with the whole cleaning chain): rename, drop, impute, log1p."""
    return cleaning.clean_data(common.raw(spark, sf), categoricals=CAT)


@query("lookup_rows", with_views(
    "SELECT * FROM dropped WHERE id IN (SELECT id FROM predictions WHERE dataset = 'test' AND true_label = 1)",
    "dropped", "predictions"))
def lookup_rows(spark, sf):
    """Fetch rows by a key set (left semi join, keys never collected)."""
    from ..sources import tables
    d = cleaning.drop_columns(cleaning.rename_columns(common.raw(spark, sf)))
    keys = tables.predictions(spark, sf).where((F.col("dataset") == "test") & (F.col("true_label") == 1))
    return d.join(keys.select("id"), "id", "left_semi")


@query("hash_split", with_views("SELECT id, dataset FROM split", "split"))
def hash_split(spark, sf):
    """H3: 80/10/10 split from a keyed hash of the id."""
    d = cleaning.rename_columns(common.raw(spark, sf)).select("id")
    return features.hash_split(d)


_STRAT = """
SELECT id, status,
  CASE WHEN pr < 0.8 THEN 'train' WHEN pr < 0.9 THEN 'validation' ELSE 'test' END AS dataset
FROM (SELECT id, status,
        COALESCE(CAST(RANK() OVER (PARTITION BY status ORDER BY u) - 1 AS DOUBLE)
                 / NULLIF(CAST(COUNT(*) OVER (PARTITION BY status) - 1 AS DOUBLE), 0), 0.0) AS pr
      FROM (SELECT id, status, {u} AS u FROM renamed))
"""


@query("stratified_split", with_views(_STRAT.format(u=unit_hash_sql("id", config.SPLIT_SALT)), "renamed"))
def stratified_split(spark, sf):
    """H3 stratified: each class split 80/10/10 by its own hash order."""
    d = cleaning.rename_columns(common.raw(spark, sf)).select("id", "status")
    return features.stratified_split(d)


_SCALED_SQL = "SELECT id, dataset, status, " + ", ".join(config.SCALED_COLS) + " FROM prepared"


@query("standardize", with_views(_SCALED_SQL, "prepared"), config.SCALED_COLS)
def standardize(spark, sf):
    """H2: clean (fit on train) then (x - mean_train) / std_train."""
    p = features.prepared(common.raw(spark, sf))
    return p.select("id", "dataset", "status", *config.SCALED_COLS)


# Levels of the fixture categoricals (their domains in the driver tables), for
# the oracle only: the Spark side discovers them from the training rows.
FIXTURE_LEVELS = {
    "gender": ["Female", "Joint", "Male", "Sex Not Available"],
    "loan_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "credit_type": ["F", "O", "P"],
    "region": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "age": ["25-34", "35-44", "<25", ">74"],
}


def _one_hot_sql():
    cols = ["id"] + [f"CASE WHEN {c} = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS \"{c}_{v}\""
                     for c in CAT for v in FIXTURE_LEVELS[c]]
    return with_views("SELECT " + ", ".join(cols) + " FROM prepared", "prepared")


@query("one_hot", _one_hot_sql())
def one_hot(spark, sf):
    """H1: one 0/1 column per level, all levels, byte order (levels fitted on train)."""
    return features.prepared_encoded(common.raw(spark, sf), CAT, keep=["id"])


def _one_hot_sparse_sql():
    every = [(c, v) for c in CAT for v in FIXTURE_LEVELS[c]]
    return with_views("\nUNION ALL ".join(
        f"SELECT id, CAST({len(config.SCALED_COLS) + i} AS BIGINT) AS position, '{c}' AS \"column\", {c} AS level, "
        f"CAST(1 AS DOUBLE) AS value FROM prepared WHERE {c} = '{v}'" for i, (c, v) in enumerate(every)), "prepared")


@query("one_hot_sparse", _one_hot_sparse_sql())
def one_hot_sparse(spark, sf):
    """H1 with any number of levels: the categorical entries of the sparse vector, named from the level table."""
    raw = common.raw(spark, sf)
    p = cut_lineage(features.fit_prep(raw).transform(raw))
    index = features.fit_index(p.where(F.col("dataset") == "train"), CAT)
    vectors = features.encode_sparse(p, CAT, index, config.SCALED_COLS).select("id", vector_to_array("features").alias("v"))
    entries = vectors.select("id", F.posexplode("v").alias("position", "value")).where("value <> 0")
    names = features.vector_positions(index, CAT, len(config.SCALED_COLS))
    return entries.join(names, "position").select("id", F.col("position").cast("long").alias("position"), "column", "level", "value")
