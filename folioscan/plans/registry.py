"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.plans import graph_queries, table_queries, text_queries

BOOKS = (text_queries.BOOK, table_queries.BOOK, graph_queries.BOOK)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
