"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_text(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", *(F.expr(e).alias(c) for c, e in columns.items()))


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value).upper() if isinstance(value, bool) else str(value)
    return "'" + value.replace("'", "''") + "'"


def fixed(columns: str, rows: Iterable[tuple]) -> str:
    """SQL of fixed rows, for answers that don't depend on the data. Whole numbers are BIGINT."""
    names = columns.split(", ")
    one = lambda v: literal(v) + ("::BIGINT" if isinstance(v, int) and not isinstance(v, bool) else "")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"
