"""Mapping of source columns to target columns, and the order of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import normalize, resolve
from .profile import col


@dataclass
class Mapping:
    """``pairs``: source -> target. ``dropped``: sources without target. ``missing``: targets without source."""

    pairs: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def by_name(sources: Sequence[str], targets: Sequence[str], explicit: dict[str, str] | None = None) -> Mapping:
    """Explicit pairs first, then names that are equal once normalised. The first source wins a target."""
    out, free = Mapping(), list(targets)
    for s, t in (explicit or {}).items():
        own, name = resolve(s, sources), resolve(t, free)
        if own is not None and name is not None:
            out.pairs[own] = name
            free.remove(name)
    for s in sources:
        name = next((t for t in free if normalize(t) == normalize(s)), None) if s not in out.pairs else None
        if name is not None:
            out.pairs[s] = name
            free.remove(name)
    out.dropped = [s for s in sources if s not in out.pairs]
    out.missing = free
    return out


def ignoring_case(sources: Sequence[str], targets: Sequence[str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """New names for sources: explicit targets in the target's own case, else targets that differ in case alone, else unchanged."""
    given = {k.lower(): v for k, v in (explicit or {}).items()}
    names = {s: resolve(given.get(s.lower(), s), targets) or given.get(s.lower(), s) for s in sources}
    return names


def apply(df: DataFrame, mapping: Mapping) -> DataFrame:
    return df.select(*(col(s).alias(t) for s, t in mapping.pairs.items()))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(col(c).alias(names.get(c, c)) for c in df.columns))


def in_order(df: DataFrame, targets: Sequence[str], types: dict[str, str] | None = None, fill: bool = True) -> DataFrame:
    """Columns in the order of ``targets``; those that are missing are null, or left out without ``fill``. Others go."""
    out = []
    for t in targets:
        if t in df.columns:
            out.append(col(t))
        elif fill:
            out.append(F.lit(None).cast((types or {}).get(t, "string")).alias(t))
    return df.select(*out)
