"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from . import q_cleaning, q_explain, q_metrics, q_models, q_neighbors, q_profile  # noqa: F401
from .registry import CHECK, ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Counterfactual flip summary: clean -> standardise -> score -> top cases -> search -> verify."""
    return QUERIES["flip_summary"](spark, sf_dir)
