"""Outliers by interquartile range, by z-score and by isolation forest. What is outside is told by a few numbers, measured for all columns at once."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import col

#: Quartiles of at most this many values are taken from all of them at once; of more, from the range that a sketch has narrowed down to so many.
AT_ONCE = 1_000_000
ACCURACY = 10_000
#: Isolation forest: trees, rows of a tree, and the rows that trees are drawn from, which are those of the smallest hashes.
TREES, TREE_ROWS, FOREST_ROWS = 100, 256, 10_000


@dataclass(frozen=True)
class Bounds:
    """Values outside are outliers. Without bounds none are."""

    low: float | None
    high: float | None

    def outside(self, value: Column) -> Column:
        if self.low is None:
            return F.lit(False)
        return F.coalesce((value < self.low) | (value > self.high), F.lit(False))


@dataclass(frozen=True)
class Spans:
    """Values within any of the spans (from, to], open ends being infinite, are outliers."""

    spans: tuple[tuple[float, float], ...]

    def outside(self, value: Column) -> Column:
        out = F.lit(False)
        for a, b in self.spans:
            out = out | ((value > a) & (value <= b))
        return F.coalesce(out, F.lit(False))


NONE = Bounds(None, None)


def quartiles(df: DataFrame, names: Iterable[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(values, first quartile, third quartile) by column, exact, interpolated as ``percentile`` does. All columns in each pass: one pass where
    they have at most AT_ONCE values, else the ranges that hold the quartiles are narrowed by sketches until they are as short."""
    names = list(names)
    if not names:
        return {}
    double = {c: col(c).cast("double") for c in names}
    total = df.agg(*(F.count(double[c]).alias(f"n{i}") for i, c in enumerate(names))).first()
    n = {c: total[i] for i, c in enumerate(names)}
    if max(n.values()) <= AT_ONCE:
        row = df.agg(*(F.percentile(double[c], F.lit(q)) for c in names for q in (0.25, 0.75))).first()
        return {c: (n[c], row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}
    open_, done = {}, {}
    for c in names:
        for q in (0.25, 0.75):
            if n[c]:
                open_[c, q] = [-math.inf, math.inf, 0, n[c]]  # the range, the values below it, the values in it
    while wide := {k: v for k, v in open_.items() if v[3] > AT_ONCE and v[0] < v[1]}:
        within = lambda k: F.when(double[k[0]].between(*open_[k][:2]), double[k[0]])
        ends = []
        for k, (_, _, below, inside) in wide.items():
            at = k[1] * (n[k[0]] - 1) - below
            shares = (max(0.0, math.floor(at) / inside - 3 / ACCURACY), min(1.0, (math.ceil(at) + 1) / inside + 3 / ACCURACY))
            ends += [F.approx_percentile(within(k), share, ACCURACY) for share in shares]
        row = df.agg(*ends).first()
        narrow = {k: (row[2 * i], row[2 * i + 1]) for i, k in enumerate(wide)}
        row = df.agg(*(x for k, (a, b) in narrow.items() for x in (F.count_if(double[k[0]] < a), F.count_if(double[k[0]].between(a, b))))).first()
        for i, (k, (a, b)) in enumerate(narrow.items()):
            at = k[1] * (n[k[0]] - 1)
            if [a, b] == open_[k][:2] or row[2 * i] > at or row[2 * i] + row[2 * i + 1] <= math.ceil(at):
                raise RuntimeError(f"{k[0]}: a range of {open_[k][3]} values can't be narrowed to one that holds the quartile")
            open_[k] = [a, b, row[2 * i], row[2 * i + 1]]
    short = {k: v for k, v in open_.items() if v[0] < v[1]}
    lists = df.agg(*(F.sort_array(F.collect_list(F.when(double[k[0]].between(*v[:2]), double[k[0]]))).alias(f"x{i}") for i, (k, v) in enumerate(short.items())), F.lit(0)).first()
    for k, v in open_.items():
        at = k[1] * (n[k[0]] - 1)
        if v[0] == v[1]:
            done[k] = v[0]
            continue
        values, low, high = lists[list(short).index(k)], math.floor(at), math.ceil(at)
        a, b = values[low - v[2]], values[high - v[2]]
        done[k] = a if low == high else (high - at) * a + (at - low) * b
    return {c: (n[c], done.get((c, 0.25)), done.get((c, 0.75))) for c in names}


def iqr(n: int, low: float | None, high: float | None, k: float, least: int) -> Bounds:
    return NONE if n < least else Bounds(low - k * (high - low), high + k * (high - low))


def iqr_bounds(df: DataFrame, name: str, k: float = 1.5, least: int = 4) -> Bounds:
    """Quartiles less and plus k times their distance."""
    return iqr(*quartiles(df, [name])[name], k, least)


def z_of(n: int, mean: float | None, sd: float | None, z: float, least: int = 4) -> Bounds:
    return NONE if n < least or not sd else Bounds(mean - z * sd, mean + z * sd)


def path_length(n: float) -> float:
    """Mean depth of a search that fails, in a tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def forest_spans(values: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42) -> Spans:
    """Spans that an isolation forest on one column finds odd: where 2 ** (-mean depth / expected depth) is over 0.5. The mean depth of one
    column is a step function of the value, so the whole forest is a short list of spans."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(values))
    cuts: list[tuple[float, float]] = []  # (where, change of the depths' sum beyond it)
    start = 0.0
    for _ in range(trees):
        stack = [(np.sort(rng.choice(values, rows, replace=False)), -math.inf, 0)]
        most = math.ceil(math.log2(max(2, rows)))
        steps: list[tuple[float, float]] = []  # (lower end, depth) of each leaf, in order
        while stack:
            own, low, depth = stack.pop()
            if depth >= most or len(own) <= 1 or own[0] == own[-1]:
                steps.append((low, depth + path_length(len(own))))
                continue
            at = rng.uniform(own[0], own[-1])
            k = int(np.searchsorted(own, at, "right"))
            stack += [(own[k:], at, depth + 1), (own[:k], low, depth + 1)]
        start += steps[0][1]
        cuts += [(low, d - before) for (low, d), (_, before) in zip(steps[1:], steps, strict=False)]
    limit, depth, spans, low = trees * path_length(rows), start, [], -math.inf
    odd = depth < limit
    for where, change in sorted(cuts):
        depth += change
        if odd and depth >= limit:
            spans.append((low, where))
        elif not odd and depth < limit:
            low = where
        odd = depth < limit
    return Spans((*spans, (low, math.inf)) if odd else tuple(spans))


def bounds_of(df: DataFrame, wanted: dict[str, tuple[str, float | None, int]]) -> dict[str, Bounds | Spans]:
    """By column (method, factor, least number of values): all columns of a method are measured together. Columns that hold no numbers have no outliers."""
    out: dict[str, Bounds | Spans] = dict.fromkeys(wanted, NONE)
    by: dict[str, list[str]] = {"iqr": [], "zscore": [], "forest": []}
    for c, (method, _, _) in wanted.items():
        if method not in by:
            raise ValueError(f"unknown method: {method!r}")
        if isinstance(df.schema[c].dataType, T.NumericType):
            by[method].append(c)
    for c, found in quartiles(df, by["iqr"]).items():
        out[c] = iqr(*found, 1.5 if wanted[c][1] is None else wanted[c][1], wanted[c][2])
    if by["zscore"]:
        row = df.agg(*(f(col(c)) for c in by["zscore"] for f in (F.count, F.avg, F.stddev_pop))).first()
        for i, c in enumerate(by["zscore"]):
            out[c] = z_of(*row[3 * i : 3 * i + 3], 3.0 if wanted[c][1] is None else wanted[c][1], wanted[c][2])
    for c in by["forest"]:
        value = col(c).cast("double")
        kept = df.where(value.isNotNull()).select(value.alias("v")).orderBy(F.xxhash64(F.monotonically_increasing_id(), value)).limit(FOREST_ROWS)
        values = kept.toArrow()["v"].to_numpy()  # at most FOREST_ROWS
        out[c] = forest_spans(np.sort(values)) if len(values) >= wanted[c][2] else NONE
    return out


def bounds(df: DataFrame, name: str, method: str = "iqr", factor: float | None = None, least: int = 4) -> Bounds | Spans:
    return bounds_of(df, {name: (method, factor, least)})[name]


def valid_mask(df: DataFrame, name: str, method: str = "iqr", factor: float | None = None) -> Column:
    return ~bounds(df, name, method, factor).outside(col(name))


def null_outliers(df: DataFrame, name: str, method: str = "iqr", factor: float | None = None) -> DataFrame:
    return df.withColumn(name, F.when(valid_mask(df, name, method, factor), col(name)))
