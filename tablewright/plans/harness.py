"""A fixed cycle of insert, upsert and update over ten rows, and checks of the table after each step."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import schema_of
from ..operators import dml
from ..operators.ordinals import ORDINAL, with_ordinal
from ..operators.profile import absent, col
from ..sources.store import Store

ROWS = 10
INSERTED, CHANGED, ADDED, UPDATED = range(0, 6), range(3, 6), range(6, 8), (1, 7, 8)
MARK = " ⟐m"


@dataclass
class Check:
    step: str
    passed: bool
    message: str = ""

    def __str__(self) -> str:
        return f"{'PASS' if self.passed else 'FAIL'} {self.step}" + (f": {self.message}" if self.message else "")


def mutated(value: Column, kind: T.DataType) -> Column:
    """Another value of the same type; null stays null."""
    if isinstance(kind, T.BooleanType):
        return ~value
    if isinstance(kind, T.NumericType):
        return (value + 1).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_add(value, 1)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value + F.expr("INTERVAL 1 DAY")
    return F.concat(value, F.lit(MARK)) if isinstance(kind, T.StringType) else value


class Harness:
    """Ten rows, a primary key, constraint columns apart from it, and at least one column to change."""

    def __init__(self, df: DataFrame, key: list[str], constraint: list[str], table: str = "t", order_by: list[str] | None = None):
        if not key or not constraint or set(key) & set(constraint):
            raise ValueError("key and constraint columns must be given and apart")
        if missing := [c for c in key + constraint if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")
        self.key, self.constraint, self.table = key, constraint, table
        self.mutable = [c for c in df.columns if c not in key + constraint]
        if not self.mutable:
            raise ValueError("no column is left to change")
        bad = reduce(lambda a, b: a | b, (absent(df, c) for c in key + constraint))
        n, nulls, keys, others = df.agg(
            F.count(F.lit(1)), F.count_if(bad), F.count_distinct(F.struct(*map(col, key))), F.count_distinct(F.struct(*map(col, constraint)))
        ).first()
        if n != ROWS or nulls or keys != ROWS or others != ROWS:
            raise ValueError(f"ten rows with unique, complete keys and constraints are needed: {n} rows, {nulls} incomplete")
        self.rows = with_ordinal(df, order_by or key)
        self.schema = schema_of(df.schema, key, [constraint])

    def at(self, places) -> DataFrame:
        return self.rows.where((F.col(ORDINAL) - 1).isin(*places))

    def mutate(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: mutated(col(c), df.schema[c].dataType) for c in self.mutable})

    def insert_rows(self) -> DataFrame:
        return self.at(INSERTED)

    def upsert_rows(self) -> DataFrame:
        return self.mutate(self.at(CHANGED)).unionByName(self.at(ADDED))

    def update_rows(self) -> DataFrame:
        return self.mutate(self.at(UPDATED))

    def after_insert(self) -> DataFrame:
        return self.insert_rows()

    def after_upsert(self) -> DataFrame:
        return self.at(range(0, 3)).unionByName(self.upsert_rows())

    def after_cycle(self) -> DataFrame:
        """The update changes rows 1 and 7, from their first values; row 8 isn't in the table."""
        new = self.update_rows().where((F.col(ORDINAL) - 1) < 8)
        return self.after_upsert().join(new.select(ORDINAL), ORDINAL, "left_anti").unionByName(new)

    def differences(self, actual: DataFrame, expected: DataFrame, rtol: float = 1e-5, atol: float = 1e-8, seconds: float = 5) -> DataFrame:
        """Rows that only one side has, or that differ: numbers by tolerance, times by seconds, others exactly; nulls equal nulls."""
        a, e = actual.select(*map(col, self.schema.names)).alias("a"), expected.select(*map(col, self.schema.names)).alias("e")
        on = reduce(lambda x, y: x & y, (F.col(f"a.`{k}`") == F.col(f"e.`{k}`") for k in self.key))
        differ = F.col(f"a.`{self.key[0]}`").isNull() | F.col(f"e.`{self.key[0]}`").isNull()
        for f in actual.select(*map(col, self.schema.names)).schema:
            x, y = F.col(f"a.`{f.name}`"), F.col(f"e.`{f.name}`")
            if isinstance(f.dataType, T.FractionalType):
                near = F.abs(x - y) <= atol + rtol * F.abs(y)
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                near = F.abs(F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))) <= seconds * 1_000_000
            else:
                near = x == y
            differ = differ | ~F.coalesce(near, x.isNull() & y.isNull())
        return a.join(e, on, "full_outer").where(differ)

    def check(self, step: str, actual: DataFrame, expected: DataFrame) -> Check:
        n = self.differences(actual, expected).count()
        return Check(step, n == 0, f"{n} rows differ" if n else "")

    def run(self, store: Store, dialect: str = "sqlite") -> list[Check]:
        """The whole cycle on a new table."""
        store.create(self.table, self.schema, if_exists="replace")
        dml.insert(store, self.insert_rows(), self.table)
        checks = [self.check("insert", store.read(self.table), self.after_insert())]
        for step in ("upsert", "upsert again"):
            dml.upsert(store, self.upsert_rows(), self.table, self.key, dialect=dialect)
            checks.append(self.check(step, store.read(self.table), self.after_upsert()))
        changed = 0
        for row in self.update_rows().drop(ORDINAL).collect():  # three rows
            values = row.asDict()
            changed += dml.update(store, self.table, values, [(k, "=", values[k]) for k in self.key])
        checks.append(Check("update count", changed == 2, f"{changed} rows changed"))
        checks.append(self.check("full cycle", store.read(self.table), self.after_cycle()))
        return checks
