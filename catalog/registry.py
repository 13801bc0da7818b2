"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: tuple[str, ...] = (), columns: str = "") -> None:
    """A named subquery that oracle texts may build on."""
    CTES[name] = (needs, f"{name}{columns} AS (\n{body.strip()}\n)")


def with_ctes(needs: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(CTES[n][1] for n in ordered) + "\n" + body.strip()


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its oracle text."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(needs, sql)
        return fn

    return wrap
