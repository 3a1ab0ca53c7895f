"""The WHERE mini-language: conditions to Spark predicates, and to SQL text with parameters.

A condition is a string ``field op value``, a dict with field, operator and value, or a (field, op, value) triple; a list
of these holds where all do. Conditions are numbered from 1. An expression such as ``1 AND (2 OR 3)`` combines them;
without one all must hold.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import resolve

#: Operators, and dialects of statements.
OPERATORS = ("BETWEEN", "IN", "LIKE", "<=", ">=", "!=", "=", ">", "<")
DIALECTS = ("sqlite", "postgres", "postgresql", "oracle", "mysql", "mssql")
SHAPE = re.compile(r"\s*([A-Za-z_][\w$]*)\s*(BETWEEN\b|IN\b|LIKE\b|<=|>=|!=|=|>|<)\s*(.*)", re.I | re.S)
PLACEHOLDER = "?"


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


@dataclass
class Where:
    """SQL text and its parameters."""

    sql: str
    params: dict = field(default_factory=dict)


def unquote(text: str) -> str:
    return text.strip().strip("'").strip('"')


def split_values(op: str, raw: str):
    raw = raw.strip()
    if op == "IN":
        inner = raw[1:-1] if raw.startswith("(") and raw.endswith(")") else raw
        return [unquote(x) for x in next(csv.reader([inner], quotechar="'", skipinitialspace=True), [])] if inner.strip() else []
    if op == "BETWEEN":
        ends = re.split(r"\s+and\s+", raw, flags=re.I)
        if len(ends) != 2:
            raise ValueError(f"BETWEEN needs two values: {raw!r}")
        return [unquote(x) for x in ends]
    return unquote(raw)


def parse(text: str) -> Condition:
    m = SHAPE.fullmatch(text)
    if not m or m[3].lstrip()[:1] in ("=", ">") and m[2] in ("=", "<", ">", "!="):
        raise ValueError(f"not a condition: {text!r}")
    op = m[2].upper()
    return Condition(m[1], op, split_values(op, m[3]))


def condition(item) -> Condition:
    if isinstance(item, Condition):
        return item
    if isinstance(item, str):
        return parse(item)
    if isinstance(item, dict):
        found = Condition(item["field"], str(item.get("operator", "=")).upper(), item.get("value"))
    elif isinstance(item, tuple) and len(item) == 3:
        found = Condition(item[0], str(item[1]).upper(), item[2])
    else:
        raise TypeError(f"not a condition: {item!r}")
    if found.op not in OPERATORS:
        raise ValueError(f"unknown operator: {found.op!r}")
    if found.op in ("IN", "BETWEEN") and isinstance(found.value, str) and found.value != PLACEHOLDER:
        return Condition(found.field, found.op, split_values(found.op, found.value))
    return found


def numbered(conditions) -> dict[int, list[Condition]]:
    """By number; a nested list is one group, all of which must hold."""
    if isinstance(conditions, (str, dict, tuple, Condition)):
        conditions = [conditions]
    return {i: [condition(x) for x in (c if isinstance(c, list) else [c])] for i, c in enumerate(conditions, 1)}


def bounds(value) -> tuple:
    return tuple(value) if isinstance(value, (list, tuple)) and len(value) == 2 else (value, value)


def listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def to_column(c: Condition, col: Column) -> Column:
    if c.op == "BETWEEN":
        return col.between(*bounds(c.value))
    if c.op == "IN":
        return col.isin(*listed(c.value)) if listed(c.value) else F.lit(False)
    if c.op == "LIKE":
        return col.contains(str(c.value))
    simple = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
    return getattr(col, simple[c.op])(F.lit(c.value))


def tokens(expression: str) -> list[str]:
    found = re.findall(r"\d+|AND\b|OR\b|[()]|\S+", expression, re.I)
    if bad := [t for t in found if not re.fullmatch(r"\d+|AND|OR|[()]", t, re.I)]:
        raise ValueError(f"unknown words in expression: {bad}")
    return [t.upper() for t in found]


def fold(expression: str, known: dict[int, object], both, either):
    """Evaluate an expression over numbered items; AND binds before OR."""
    rest = tokens(expression)

    def either_of():
        left = both_of()
        while rest and rest[0] == "OR":
            rest.pop(0)
            left = either(left, both_of())
        return left

    def both_of():
        left = one()
        while rest and rest[0] == "AND":
            rest.pop(0)
            left = both(left, one())
        return left

    def one():
        if not rest:
            raise ValueError(f"expression ends early: {expression!r}")
        t = rest.pop(0)
        if t == "(":
            inner = either_of()
            if not rest or rest.pop(0) != ")":
                raise ValueError(f"unbalanced brackets: {expression!r}")
            return inner
        if not t.isdigit() or int(t) not in known:
            raise ValueError(f"unknown condition {t} in {expression!r}")
        return known[int(t)]

    found = either_of()
    if rest:
        raise ValueError(f"unexpected {rest[0]} in {expression!r}")
    return found


def bind(conditions, columns: Iterable[str], row: dict | None = None, allow_missing: bool = False) -> dict[int, list[Condition]]:
    """Conditions with column names resolved and ``?`` replaced by the row's value. A condition on ``?`` whose column the
    row lacks is left out; so is a group that has nothing left."""
    columns, out = list(columns), {}
    for i, group in numbered(conditions).items():
        kept = []
        for c in group:
            name = resolve(c.field, columns)
            if c.value == PLACEHOLDER:
                own = resolve(c.field, row or {})
                if own is not None:
                    kept.append(Condition(name or own, c.op, row[own]))
                continue
            if name is None and not allow_missing:
                raise ValueError(f"no such column: {c.field!r}")
            kept.append(Condition(name or c.field, c.op, c.value))
        if kept:
            out[i] = kept
    return out


def predicate(conditions, expression: str | None, columns: Iterable[str], row: dict | None = None, allow_missing: bool = False) -> Column:
    """One Spark predicate, which the scan can take over. With ``allow_missing`` a condition on a column that isn't there is like one
    on null: it never holds."""
    columns = list(columns)

    def one(c: Condition) -> Column:
        return to_column(c, F.col(f"`{c.field}`")) if c.field in columns else F.lit(False)

    known = {i: reduce(lambda a, b: a & b, map(one, g)) for i, g in bind(conditions, columns, row, allow_missing).items()}
    if not known:
        return F.lit(True)
    if not expression:
        return reduce(lambda a, b: a & b, known.values())
    return fold(expression, known, lambda a, b: a & b, lambda a, b: a | b)


def where(df: DataFrame, conditions, expression: str | None = None, row: dict | None = None, allow_missing: bool = False) -> DataFrame:
    return df.where(predicate(conditions, expression, df.columns, row, allow_missing))


def select(df: DataFrame, conditions, columns: list[str] | None = None, expression: str | None = None, row: dict | None = None, allow_missing: bool = False) -> DataFrame:
    """Projection of what a condition selects; names match in any case."""
    found = where(df, conditions, expression, row, allow_missing)
    if not columns:
        return found
    names = [resolve(c, df.columns) for c in columns]
    if None in names:
        raise ValueError(f"no such columns: {[c for c, n in zip(columns, names, strict=True) if n is None]}")
    return found.select(*(F.col(f"`{n}`").alias(c) for c, n in zip(columns, names, strict=True)))


# SQL text


def escape_like(value) -> str:
    return re.sub(r"([\\%_])", r"\\\1", str(value))


def condition_sql(c: Condition, number: int, part: int, dialect: str, params: dict) -> str:
    base = f"{c.field}_{number}" + (f"_g{part}" if part else "")

    def put(name: str, value) -> str:
        params[name] = value
        return f":{name}"

    if c.op == "BETWEEN":
        low, high = bounds(c.value)
        return f"{c.field} BETWEEN {put(f'{base}_0', low)} AND {put(f'{base}_1', high)}"
    if c.op == "IN":
        values = [put(f"{base}_{i}", v) for i, v in enumerate(listed(c.value))]
        return f"{c.field} IN ({', '.join(values)})" if values else "1 = 0"
    if c.op == "LIKE":
        return f"{c.field} LIKE {put(base, f'%{escape_like(c.value)}%')}" + ("" if dialect == "sqlite" else " ESCAPE '\\'")
    return f"{c.field} {c.op} {put(base, c.value)}"


def where_sql(groups: dict[int, list[Condition]], expression: str | None = None, dialect: str = "sqlite") -> Where:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect!r}")
    params: dict = {}
    texts = {}
    for i, group in groups.items():
        parts = [condition_sql(c, i, k, dialect, params) for k, c in enumerate(group)]
        texts[i] = parts[0] if len(parts) == 1 else f"({' AND '.join(parts)})"
    if not expression:
        return Where(" AND ".join(texts.values()), params)
    return Where(fold(expression, texts, lambda a, b: f"({a} AND {b})", lambda a, b: f"({a} OR {b})"), params)


def only_row(data) -> dict:
    """The one row of a dict, list of dicts or DataFrame."""
    if isinstance(data, DataFrame):
        data = [r.asDict() for r in data.limit(2).collect()]
    rows = [data] if isinstance(data, dict) else list(data)
    if len(rows) != 1 or not isinstance(rows[0], dict):
        raise ValueError("exactly one row is needed")
    return rows[0]


def build_select(data, table: str, conditions, dialect: str = "sqlite", expression: str | None = None, columns: list[str] | None = None, allow_missing: bool = False) -> Where:
    row = only_row(data)
    w = where_sql(bind(conditions, row, row, allow_missing), expression, dialect)
    return Where(f"SELECT {', '.join(columns) if columns else '*'} FROM {table}" + (f" WHERE {w.sql}" if w.sql else ""), w.params)


def build_update(data, table: str, conditions, dialect: str = "sqlite", expression: str | None = None, columns: list[str] | None = None, allow_missing: bool = True) -> Where:
    row = only_row(data)
    names = columns or list(row)
    if missing := [c for c in names if resolve(c, row) is None]:
        raise ValueError(f"no such columns: {missing}")
    w = where_sql(bind(conditions, row, row, allow_missing), expression, dialect)
    sets = {f"u_{c}": row[resolve(c, row)] for c in names}
    text = f"UPDATE {table} SET {', '.join(f'{c} = :u_{c}' for c in names)}" + (f" WHERE {w.sql}" if w.sql else "")
    return Where(text, sets | w.params)


def build_insert(data, table: str, dialect: str = "sqlite") -> Where:
    row = only_row(data)
    return Where(f"INSERT INTO {table} ({', '.join(row)}) VALUES ({', '.join(f':i_{c}' for c in row)})", {f"i_{c}": v for c, v in row.items()})
