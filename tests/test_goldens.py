"""Golden rows: the importance table is a pure function of the coefficients."""

import math

import pytest

from riskframe.operators import explain

# Ten (feature, coefficient) pairs of the published top-features table.
GOLDEN = [
    ("credit_type_EQUI", 37.67128487878618),
    ("credit_type_EXP", -11.70156401718503),
    ("credit_type_CIB", -11.653939356316451),
    ("credit_type_CRIF", -11.614869733965142),
    ("construction_type_mh", 5.310042635095295),
    ("security_type_Indriect", 5.310042635095295),
    ("secured_by_land", 5.310042635095295),
    ("lump_sum_payment_lpsm", 2.6196504786278805),
    ("secured_by_home", -2.6091308638134247),
    ("construction_type_sb", -2.6091308638134247),
]
# The published odds ratios and effects for those rows.
EXPECTED_ODDS = [2.2931430578664612e+16, 8.28085762373589e-06, 8.684772472957438e-06, 9.030798798158204e-06,
                 202.35885579333163, 202.35885579333163, 202.35885579333163, 13.73092349503931,
                 0.07359848307796606, 0.07359848307796606]
EXPECTED_EFFECT = ["increases_risk", "decreases_risk", "decreases_risk", "decreases_risk", "increases_risk",
                   "increases_risk", "increases_risk", "increases_risk", "decreases_risk", "decreases_risk"]


def test_importance_matches_published_rows(spark):
    coefs = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(GOLDEN)],
                                  "feature_index int, feature string, coefficient double")
    top = explain.top_features(explain.feature_importance(coefs), 10).orderBy("rank").collect()
    assert [r.feature for r in top] == [f for f, _ in GOLDEN]
    assert [r.effect for r in top] == EXPECTED_EFFECT
    for r, (_, c), o in zip(top, GOLDEN, EXPECTED_ODDS):
        assert r.abs_coefficient == pytest.approx(abs(c), rel=1e-15)
        assert math.isclose(r.odds_ratio, o, rel_tol=1e-12)


def test_odds_ratio_is_clipped(spark):
    coefs = spark.createDataFrame([(0, "big", 80.0), (1, "small", -80.0), (2, "zero", 0.0)],
                                  "feature_index int, feature string, coefficient double")
    rows = {r.feature: r for r in explain.feature_importance(coefs).collect()}
    assert rows["big"].odds_ratio == pytest.approx(math.exp(50))
    assert rows["small"].odds_ratio == pytest.approx(math.exp(-50))
    assert rows["zero"].effect == "increases_risk"  # >= 0 goes to the increasing side


def test_signed_top_lists(spark):
    coefs = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(GOLDEN)],
                                  "feature_index int, feature string, coefficient double")
    rows = explain.top_signed_features(coefs, 5).collect()
    pos = [r.feature for r in sorted((r for r in rows if r.side == "positive"), key=lambda r: r.rank)]
    neg = [r.feature for r in sorted((r for r in rows if r.side == "negative"), key=lambda r: r.rank)]
    assert pos[0] == "credit_type_EQUI" and pos[1:4] == ["construction_type_mh", "security_type_Indriect",
                                                         "secured_by_land"]
    assert neg[:2] == ["credit_type_EXP", "credit_type_CIB"]


def test_mismatched_names_raise(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "feature_index int, feature string")
    coefs = spark.createDataFrame([(0, 1.0)], "feature_index int, coefficient double")
    with pytest.raises(ValueError):
        explain.pair_names(names, coefs)
