"""Constraint checks. Each is a query: aggregates, semi joins and anti joins; keys never come to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import resolve
from ..functions.types import ForeignKey, TableSchema
from .profile import absent, col


class ConstraintError(ValueError):
    pass


def required_missing(columns: Sequence[str], schema: TableSchema) -> list[str]:
    """Columns that a row must have and ``columns`` lacks."""
    return [c.name for c in schema.columns if not c.nullable and c.default is None and not c.has_server_default and c.writeable and resolve(c.name, columns) is None]


def null_counts(df: DataFrame, schema: TableSchema) -> dict[str, int]:
    """Nulls in columns that may not be null, of those that have any."""
    names = [c.name for c in schema.columns if not c.nullable and c.name in df.columns]
    if not names:
        return {}
    row = df.agg(*(F.count_if(absent(df, c)).alias(c) for c in names)).first()
    return {c: row[c] for c in names if row[c]}


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many. Nulls equal nulls."""
    return df.groupBy(*(col(c) for c in key)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> int:
    """Rows that share their key with another."""
    return repeated_keys(df, key).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def has_duplicates(df: DataFrame, key: Sequence[str]) -> bool:
    return not repeated_keys(df, key).isEmpty()


def whole_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys without nulls."""
    found = df.select(*(col(c) for c in key))
    return found.where(~_any_absent(found)).distinct()


def _any_absent(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in df.columns:
        out = out | absent(df, c)
    return out


def _on(a: DataFrame, b: DataFrame, mine: Sequence[str], theirs: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(mine, theirs, strict=True):
        out = out & (a[x] == b[y])
    return out


def orphans(df: DataFrame, parent: DataFrame, key: ForeignKey) -> DataFrame:
    """Distinct whole keys of ``df`` that ``parent`` lacks."""
    own, known = whole_keys(df, key.columns), parent.select(*(col(c) for c in key.references))
    return own.join(known, _on(own, known, key.columns, key.references), "left_anti")


def already_there(df: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct whole keys of ``df`` that ``target`` has."""
    own, known = whole_keys(df, key), target.select(*(col(c) for c in key))
    return own.join(known, _on(own, known, key, key), "left_semi")


def conflict_key(keys: Sequence[str], schema: TableSchema, subset: bool = False) -> tuple[str, ...]:
    """The primary key or unique set that ``keys`` are, in any order and case (or, with ``subset``, lie within); else an error."""
    wanted = {k.lower() for k in keys}
    for known in schema.key_sets():
        names = {k.lower() for k in known}
        if wanted == names or subset and wanted and wanted <= names:
            return known
    raise ConstraintError(f"{list(keys)} are neither the primary key nor a unique set of the table")
