"""The per-case store: files in proportion to rows, all of a commit or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from riskframe.sources import cases


def _files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_files_grow_with_rows_not_with_cases_or_tasks(spark, tmp_path):
    path = str(tmp_path / "store")
    # 10,000 cases from 200 tasks, and one case with a third of the rows
    df = spark.range(0, 45_000, 1, 200).selectExpr("IF(id < 15000, -1, id % 10000) AS case_id", "id AS value")
    cases.write_cases(df, path, "case_id", rows_per_file=5_000)
    assert len(_files(f"{path}/rows")) <= 2 * 45_000 // 5_000
    back = cases.read_cases(spark, path)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    held = cases.manifest(spark, path)
    want = {r.case_id: r.n for r in df.groupBy("case_id").agg(F.count("*").alias("n")).collect()}
    assert {r.case_key: r.n for r in held.groupBy("case_key").agg(F.sum("n_rows").alias("n")).collect()} == want
    assert max(r.n for r in held.groupBy("file_name").agg(F.sum("n_rows").alias("n")).collect()) <= 5_000
    assert held.where("case_key = -1").count() >= 3
    one = cases.read_cases(spark, path, [17, 123_456])
    assert sorted(one.collect()) == sorted(df.where("case_id = 17").collect())
    assert cases.read_cases(spark, path, [123_456]).collect() == []


def test_readers_see_all_of_a_write_or_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        cases.read_cases(spark, path)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    cases.write_cases(first, path, "k")
    broken = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise("x").alias("t"))
    with pytest.raises(Exception, match="lost"):
        cases.write_cases(broken, path, "k")
    # rows and manifest of a write that never came to its commit
    first.write.csv(f"{path}/rows/half")
    assert sorted(cases.read_cases(spark, path).collect()) == sorted(first.collect())
    second = spark.createDataFrame([(3, "c")], "k long, t string")
    cases.write_cases(second, path, "k")
    assert cases.read_cases(spark, path).collect() == second.collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_edges(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    rows = [(None, "x", None, True), (1, 'two "lines",\nquoted', 0.1, True), (1, "", -1e300, True), (1, "", -1e300, True), (1, " \\", 0.0, True),
            (2, None, 5.0, False), (3, "file_name", 2.0, None)]
    df = spark.createDataFrame(rows, "case_key long, file_name string, n_rows double, success boolean")
    cases.write_cases(df, path, "case_key", fmt=fmt)
    back = cases.read_cases(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows[:5], key=str)
    assert [tuple(r) for r in cases.read_cases(spark, path, [None]).collect()] == rows[:1]
    cases.write_cases(df.limit(0), path, "case_key", fmt=fmt)
    assert cases.read_cases(spark, path).collect() == [] and cases.manifest(spark, path).count() == 0
