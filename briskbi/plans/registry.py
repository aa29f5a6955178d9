"""Registry of queries over the driver tables and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` that calls the
library's operators on whole tables; ``ORACLE`` holds, per key, SQL that DuckDB
runs on the same parquet files.  Output columns carry the same names on both
sides.  Money columns in the driver tables hold exact cents, so sums are
accumulated as DECIMAL(38,2) on both sides (``scale=2``): the totals are exact
and do not depend on partitioning or summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def dec(c: str) -> str:
    """DuckDB: exact cents accumulation of a money column."""
    return f"CAST({c} AS DECIMAL(38,2))"
