"""Registry of the core queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlex.plans import corpus_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (corpus_queries, table_queries)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
