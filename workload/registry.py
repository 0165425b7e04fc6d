"""Name -> (Spark query, SQL check)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that must give the same rows where SQL can express it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_views(*parts: str) -> str:
    """``WITH a, b, c SELECT ...`` from view texts and a final select."""
    *views, body = parts
    joint = ",\n" if body.lstrip().split(" ", 2)[1:2] == ["AS"] else "\n"
    return "WITH " + ",\n".join(views) + joint + body
