"""All queries of the library, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import event_queries, page_queries, pass_queries, tree_queries, url_queries
from pagemill.shipping import shipped

_GROUPS = (page_queries, tree_queries, pass_queries, url_queries, event_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(query) for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
