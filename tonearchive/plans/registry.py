"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import published
from ..sources.signals import SQL as SIGNALS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, signal: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``signal`` names the derived table that its SQL starts from."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            text = sql.strip()
            head = SIGNALS[signal] if signal else ""
            ORACLE_SQL[name] = f"with {head}, {text[5:]}" if head and text.startswith("with ") else f"with {head} {text}" if head else text
        return function

    return add


def out(df: DataFrame, longs: str = "", doubles: str = "", texts: str = "") -> DataFrame:
    """The named columns: whole numbers as long, doubles as published, texts as they are."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in longs.split()], *[published(c).alias(c) for c in doubles.split()], *texts.split())


def r(expression: str, name: str = "") -> str:
    """SQL of a published double."""
    x = f"({expression})"
    return f"case when {x} is not null and not isnan({x}) and not isinf({x}) then floor({x} * 1e6 + 0.5) / 1e6 + 0.0 end" + (f" as {name}" if name else "")
