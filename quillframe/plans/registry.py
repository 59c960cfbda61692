"""Where plans register themselves, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a plan under its function name, with its oracle if SQL can express it."""

    def add(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return add
