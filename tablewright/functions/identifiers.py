"""Identifiers: headers, sanitised column names, normalisation and quoting for five SQL dialects. Driver-side text only."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable

DIALECTS = ("oracle", "sqlite", "mssql", "mysql", "postgresql")
MAX_CONSTRAINT_NAME = 30

#: Words that each dialect reserves.
RESERVED = {
    "oracle": (
        "SELECT", "INSERT", "DELETE", "UPDATE", "WHERE", "FROM", "GROUP", "ORDER", "BY", "CREATE", "TABLE", "INDEX", "VIEW",
        "PRIMARY", "KEY", "FOREIGN", "CONSTRAINT", "NUMBER", "DATE", "UNION", "ALL", "DISTINCT", "JOIN", "INNER", "OUTER",
        "LEFT", "RIGHT", "ON", "USING", "HAVING", "LIMIT", "OFFSET", "ALTER", "DROP", "TRUNCATE", "USER", "LEVEL", "ACCESS",
        "MODE",
    ),
    "postgresql": (
        "SELECT", "INSERT", "DELETE", "UPDATE", "WHERE", "FROM", "GROUP", "ORDER", "BY", "CREATE", "TABLE", "PRIMARY", "KEY",
        "FOREIGN", "CONSTRAINT", "REFERENCES", "BIGINT", "INTEGER", "SMALLINT", "VARCHAR", "TIMESTAMP", "BOOLEAN", "NUMERIC",
        "DECIMAL", "REAL",
    ),
    "mysql": (
        "SELECT", "INSERT", "DELETE", "UPDATE", "WHERE", "FROM", "TABLE", "CREATE", "DROP", "ALTER", "PRIMARY", "KEY",
        "FOREIGN", "CONSTRAINT", "INT", "VARCHAR", "DATETIME", "BIGINT", "SMALLINT", "AUTO_INCREMENT", "UNIQUE", "INDEX",
    ),
    "mssql": (
        "SELECT", "INSERT", "DELETE", "UPDATE", "WHERE", "FROM", "TABLE", "CREATE", "DROP", "ALTER", "PRIMARY", "KEY",
        "FOREIGN", "CONSTRAINT", "IDENTITY", "INT", "VARCHAR", "DATETIME", "BIT", "FLOAT", "NUMERIC", "DECIMAL", "BIGINT",
        "SMALLINT",
    ),
    "sqlite": (
        "SELECT", "INSERT", "DELETE", "UPDATE", "WHERE", "FROM", "TABLE", "CREATE", "DROP", "ALTER", "CONSTRAINT", "PRIMARY",
        "KEY", "FOREIGN", "UNIQUE", "CHECK", "DEFAULT",
    ),
}


def dialect_of(server: str) -> str:
    """The dialect's full name; ``postgres`` is short for ``postgresql``."""
    name = {"postgres": "postgresql"}.get(server.lower(), server.lower())
    if name not in DIALECTS:
        raise ValueError(f"unknown dialect: {server!r}")
    return name


def unused(name: str, taken: set[str]) -> str:
    """``name``, or the first of name_1, name_2, ... that isn't taken. Marks the result as taken."""
    found, n = name, 0
    while found in taken:
        n += 1
        found = f"{name}_{n}"
    taken.add(found)
    return found


def clean_header(name: str, lower: bool = True) -> str:
    text = name.strip().lower() if lower else name.strip()
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", text)).strip("_")


def clean_headers(names: Iterable[str], lower: bool = True) -> list[str]:
    """ASCII names, unique; a name of which nothing is left becomes col_{place}."""
    taken: set[str] = set()
    return [unused(clean_header(str(x), lower) or f"col_{i}", taken) for i, x in enumerate(names)]


def sanitize_one(name: str, dialect: str, allow_space: bool, to_lower: bool) -> str:
    text = re.sub(r"[^\w ]" if allow_space else r"\W", "_", str(name).strip(), flags=re.ASCII)
    text = re.sub(r"_+", "_", text.lower() if to_lower else text).strip("_")
    if text[:1].isdigit():
        text = f"_{text}"
    if text.upper() in RESERVED[dialect_of(dialect)] or keyword.iskeyword(text.lower()):
        text += "_"
    return text


def sanitize(names, allow_space: bool = False, to_lower: bool = True, fallback: str = "col_", dialect: str = "postgresql"):
    """SQL-safe names. A string gives a string; a list gives a list of unique names; a dict gets its keys sanitised;
    a DataFrame gets its columns renamed."""
    if isinstance(names, str):
        return sanitize_one(names, dialect, allow_space, to_lower) or f"{fallback}0"
    if isinstance(names, dict):
        return dict(zip(sanitize(list(names), allow_space, to_lower, fallback, dialect), names.values(), strict=True))
    if hasattr(names, "toDF"):
        return names.toDF(*sanitize(names.columns, allow_space, to_lower, fallback, dialect))
    taken: set[str] = set()
    return [unused(sanitize_one(x, dialect, allow_space, to_lower) or f"{fallback}{i}", taken) for i, x in enumerate(names)]


def normalize(name: str) -> str:
    """For matching names: trimmed, lower case, blanks and hyphens as underscores, nothing else but word characters."""
    text = re.sub(r"[\s\-]+", "_", str(name).strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", text)).strip("_")


def escape(name: str, server: str = "oracle") -> str:
    """``name`` quoted where its dialect needs it."""
    dialect = dialect_of(server)
    odd = not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or name.upper() in RESERVED[dialect]
    if dialect == "mssql":
        return f"[{name.replace(']', ']]')}]"
    if dialect == "mysql":
        return f"`{name.replace('`', '``')}`" if odd else name
    if dialect == "oracle":
        name = name.upper()
    return '"' + name.replace('"', '""') + '"' if odd else name


def constraint_name(name: str) -> str:
    return name[:MAX_CONSTRAINT_NAME]


def resolve(name: str, columns: Iterable[str]) -> str | None:
    """The column that ``name`` means: the same name, else one that differs in case alone."""
    columns = list(columns)
    return name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)
