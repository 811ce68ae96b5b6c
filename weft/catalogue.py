"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans import context_queries, corpus_queries, graph_queries, lifecycle_queries, page_queries, queue_queries, rule_queries, search_queries, store_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}
for _module in (search_queries, graph_queries, corpus_queries, text_queries, lifecycle_queries, page_queries, queue_queries, store_queries, rule_queries, context_queries):
    _ALL |= _module.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
