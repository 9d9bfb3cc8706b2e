"""All registered queries of the engine, with their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import control_queries, function_queries, text_queries, view_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (view_queries, text_queries, control_queries, function_queries)


def queries() -> dict[str, Query]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.ORACLE.items()}
