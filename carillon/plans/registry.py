"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import rounded, rounded_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 6, many: bool = False) -> None:
    """Register a query; its doubles are rounded, as the SQL rounds its own.  many: it lists pairs, far more rows than it reads."""
    QUERIES[name] = lambda spark, sf_dir: (rounded_pairs if many else rounded)(run(spark, sf_dir), digits)
    if sql is not None:
        ORACLE_SQL[name] = sql
