"""Every registered query with an oracle equals its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from riskframe.plans import catalog
from riskframe.plans.verify import compare, duckdb_connection

ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def con(sf_small):
    return duckdb_connection(sf_small)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, sf_small, con, key):
    sdf = entry.queries()[key](spark, sf_small).toPandas()
    odf = con.sql(ORACLE[key]).df()
    ok, why = compare(sdf, odf)
    assert ok, f"{key}: {why}"


def test_every_query_has_a_check_kind():
    from riskframe.plans.catalog import CHECK
    assert set(CHECK) == set(catalog.QUERIES) and set(CHECK) <= set(entry.queries())
    # rows-only keys are the fitted models; everything else has an exact oracle
    assert {k for k, v in CHECK.items() if v == "R"} == set(catalog.QUERIES) - set(ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == ["case_index", "original_proba", "original_pred",
                                                  "num_counterfactuals", "num_flipped", "flip_rate"]
    assert len(rows) >= 0


@pytest.mark.parametrize("key", ["roc_curve", "describe_numeric", "stratified_split", "top_categories",
                                 "counterfactuals", "knn_minority", "impute_median"])
def test_same_result_with_1_and_16_partitions(spark, sf_small, key):
    from riskframe.plans.verify import normalized
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res.append(normalized(entry.queries()[key](spark, sf_small).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert res[0] == res[1]
