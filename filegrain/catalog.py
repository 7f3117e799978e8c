"""The library's queries by name, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import built, sampled  # noqa: F401  their queries join the others
from .plans.queries import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by site: detect, rate and sum up."""
    return QUERIES["scan_ranked"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
