"""Registered queries: one per operator of the survey's inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` running the operator over
whole bindings of the driver's tables, plus (where SQL can say it) the
equivalent DuckDB query used as the correctness oracle.  Parameters are
fixed per entry; reports use a period that spans every table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from rinse.plans import q_reports, q_joins, q_ranking, q_promotions, q_upkeep, q_quality  # noqa: F401
    from rinse.plans import q_streams  # noqa: F401
