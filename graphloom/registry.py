"""Every registered query of the graph engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import insight_queries, more_queries  # noqa: F401  register their queries
from graphloom.plans.queries import ORACLES, QUERIES, grf03_impact


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grf03_impact(spark, sf_dir)
