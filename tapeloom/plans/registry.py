"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def scaled(c: str, digits: int):
    """An array of numbers as one text of whole numbers, the same in every engine."""
    return F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 10**digits).cast("bigint").cast("string")), ",").alias(c)


def scaled_sql(expr: str, name: str, digits: int) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * {10**digits}) AS BIGINT) AS VARCHAR)), ',') AS {name}"


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def rounds(names, digits: int = 6) -> str:
    """Rounded output columns out of existing ones."""
    return ", ".join(r6(n, n, digits) for n in names)
