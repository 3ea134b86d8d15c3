"""Queries and their SQL, collected by a decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.sources.fixtures import FIXTURE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def with_fixtures(sql: str, names: tuple[str, ...]) -> str:
    """The SQL, with the named stand-in tables in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in FIXTURE_SQL[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({FIXTURE_SQL[name][1]})" for name in needed)
    body = sql.strip()
    more = ",\n" + body[4:].lstrip() if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH RECURSIVE {head}{more}"


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, using: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = with_fixtures(sql, using)
            return function

        return add
