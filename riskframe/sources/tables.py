"""Readers for the driver tables and the fixture views built on them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table; an explicit column list keeps the parquet scan pruned."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan applications: one row per order, customer attributes joined in.

    Columns, names and missing-value rates follow the raw loan file.  The
    join is orders x customer on the customer key: a shuffle join at scale,
    with AQE's skew handling for hot customers.
    """
    o = spread(table(spark, sf_dir, "orders", ORDER_COLS), "o_orderkey")
    c = table(spark, sf_dir, "customer", CUSTOMER_COLS)
    return applications_from(o, c)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over the cores by a digest of ``key`` where its files give them less than two tasks each.

    A table of one file with a few row groups, joined to a small one, else leaves all later
    work on a row, and every pass over what is made of it, to those few tasks."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER_COLS = ["c_custkey", "c_acctbal", "c_mktsegment"]


def applications_from(o: DataFrame, c: DataFrame) -> DataFrame:
    """The application view from an orders frame (batch or stream) and customers (static)."""
    return application_columns(o.join(c, o.o_custkey == c.c_custkey))


def application_columns(j: DataFrame) -> DataFrame:
    """The application view of rows that hold an order's and its customer's columns.

    A row's draws are columns of a projection below, so each digest is taken once
    a row, though several columns use it, and the plans above stay short.
    """
    j = j.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice", "c_acctbal", "c_mktsegment",
                 *[unit_hash("o_orderkey", salt).alias(f"_draw_{salt}") for salt in range(1, 13)])

    def u(salt: int):
        return F.col(f"_draw_{salt}")

    price = F.col("o_totalprice").cast("double")
    null_d = F.lit(None).cast("double")
    return j.select(
        F.col("o_orderkey").cast("bigint").alias("ID"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.when(u(10) < 0.02, F.lit(None).cast("string"))
         .when(u(11) < 0.3, "Male").when(u(11) < 0.55, "Joint").when(u(11) < 0.75, "Female")
         .otherwise("Sex Not Available").alias("Gender"),
        F.when(u(8) < 0.02, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("loan_type"),
        F.col("o_orderstatus").alias("credit_type"),
        F.col("c_mktsegment").alias("Region"),
        F.when(u(12) < 0.1, "<25").when(u(12) < 0.5, "25-34").when(u(12) < 0.9, "35-44")
         .otherwise(">74").alias("age"),
        price.alias("loan_amount"),
        F.when(u(1) < 0.27, null_d).otherwise(F.round(F.lit(2.0) + u(2) * 3, 3).cast("double"))
         .alias("rate_of_interest"),
        F.when(F.col("c_acctbal") < 0, null_d).otherwise(F.col("c_acctbal").cast("double")).alias("income"),
        (F.lit(500) + F.floor(u(5) * 401)).cast("double").alias("Credit_Score"),
        F.when(u(1) < 0.1, null_d).otherwise(F.round(F.lit(100) / (F.lit(1) + u(2)), 2).cast("double"))
         .alias("LTV"),
        F.when(u(1) < 0.1, null_d).otherwise(F.round(price * (F.lit(1) + u(2)), 2).cast("double"))
         .alias("property_value"),
        F.when(u(3) < 0.01, null_d).otherwise((F.lit(96) + F.lit(12) * F.floor(u(4) * 23)).cast("double"))
         .alias("term"),
        F.when(u(6) < 0.16, null_d).otherwise((F.lit(5) + F.floor(u(7) * 57)).cast("double")).alias("dtir1"),
        F.when(u(9) < F.lit(0.1) + u(7) / 4 + u(4) / 10, 1).otherwise(0).cast("int").alias("Status"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' scores per application (wide): id, true_label, dataset, p_a, p_b."""
    r = raw_applications(spark, sf_dir).select("ID", "Status", "dtir1")

    def v(salt: int):
        return unit_hash("ID", salt)

    d = F.coalesce(F.col("dtir1"), F.lit(33.0))
    return r.select(
        F.col("ID").alias("id"),
        F.col("Status").alias("true_label"),
        F.when(v(21) < 0.8, "train").when(v(21) < 0.9, "validation").otherwise("test").alias("dataset"),
        ((d / 66 + v(22)) / 2).alias("p_a"),
        F.round((d / 66 + v(23) * 3) / 4, 2).cast("double").alias("p_b"),
    )


def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction records: id, model, dataset, y, p (one row per model and application)."""
    wide = predictions(spark, sf_dir)
    return wide.select(
        "id", "dataset", F.col("true_label").alias("y"),
        F.explode(F.array(
            F.struct(F.lit("a").alias("model"), F.col("p_a").alias("p")),
            F.struct(F.lit("b").alias("model"), F.col("p_b").alias("p")),
        )).alias("m"),
    ).select("id", "m.model", "dataset", "y", "m.p")
