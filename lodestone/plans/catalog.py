"""All registered queries of the retrieval engine with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import graph_queries, ranking_queries, store_queries, text_queries

_PARTS = (text_queries, ranking_queries, graph_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in _PARTS for k, (_, sql) in part.QUERIES.items() if sql}
