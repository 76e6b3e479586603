"""Queries of the library by name, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extract_queries, graph_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (graph_queries, table_queries, extract_queries)


def queries() -> dict[str, Query]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
