"""Profiles, head and tail samples, and primary-key inference."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import is_string, to_timestamp

CATEGORICAL_RATIO = 0.1
PROFILE = "column string, dtype string, is_categorical boolean, is_unique boolean, is_datetime boolean, null_count long, non_null_count long, null_pct double, distinct_count long"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def absent(df: DataFrame, name: str) -> Column:
    """Null, or NaN, which counts as null."""
    kind = df.schema[name].dataType
    return col(name).isNull() | F.isnan(col(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(name).isNull()


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: counts, distinct values and what they suggest. One pass; ``approximate`` counts distinct values
    by a sketch, which spares the shuffle of every value."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], PROFILE)
    aggs = [F.count(F.lit(1)).alias("total")]
    count = (lambda x: F.approx_count_distinct(x, ERROR)) if approximate else F.count_distinct
    for i, f in enumerate(df.schema):
        value = F.when(~absent(df, f.name), col(f.name))
        aggs += [F.count(value).alias(f"n{i}"), count(value).alias(f"d{i}")]
        if is_string(f.dataType):
            aggs.append(F.coalesce(F.bool_and(F.when(value.isNotNull(), to_timestamp(value).isNotNull())), F.lit(True)).alias(f"t{i}"))
    row = df.agg(*aggs).where("total > 0")
    each = []
    for i, f in enumerate(df.schema):
        n, d = F.col(f"n{i}"), F.col(f"d{i}")
        dates = F.col(f"t{i}") if is_string(f.dataType) else F.lit(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)))
        each.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                ((n > 0) & (d <= n * CATEGORICAL_RATIO)).alias("is_categorical"),
                ((n > 0) & (d == n)).alias("is_unique"),
                dates.alias("is_datetime"),
                (F.col("total") - n).alias("null_count"),
                n.alias("non_null_count"),
                F.round((F.col("total") - n) * 100 / F.col("total"), 2).alias("null_pct"),
                d.alias("distinct_count"),
            )
        )
    return row.select(F.inline(F.array(*each)))


def uniqueness(found: DataFrame) -> DataFrame:
    """A profile with ``uniqueness_ratio``: distinct over non-null values, 0 if there are none."""
    ratio = F.coalesce(F.try_divide(F.col("distinct_count").cast("double"), F.col("non_null_count").cast("double")), F.lit(0.0))
    return found.withColumn("uniqueness_ratio", ratio)


@dataclass
class Sample:
    rows: DataFrame
    original_rows: int
    filtered_rows: int
    num_per_side: int
    reduction_pct: float
    warning: str | None = None


#: Rank error of the sketch that finds a sample's cut points is one in so many.
SKETCH = 1_000


def sample(df: DataFrame, percent: float = 5, order_by: str | None = None, filter_none: bool = True) -> Sample:
    """Head and tail, ``percent`` of the rows together, without repeated rows. The order is that of ``order_by``, then of all columns.

    A sketch gives values that cut off slightly more than each end, so only rows near the ends are sorted; they are numbered by ranges, in many
    tasks. Where the first column of the order is no number or time, or may hold nulls or NaN, all rows are numbered."""
    from .ordinals import ORDINAL, with_ordinal

    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    complete = ~_any_absent(df) if filter_none else F.lit(True)
    keys = [order_by, *(c for c in df.columns if c != order_by)] if order_by else df.columns
    kind, first, share = df.schema[keys[0]].dataType, col(keys[0]), percent / 200 + 2 / SKETCH
    sketched = isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)) and share < 0.5
    near = F.when(complete, first)
    cuts = [F.approx_percentile(near, at, SKETCH) if sketched else F.lit(None) for at in (min(1.0, share), max(0.0, 1 - share))]
    total, filtered, gaps, low, high = df.agg(F.count(F.lit(1)), F.count_if(complete), F.count_if(complete & absent(df, keys[0])), *cuts).first()
    if not total:
        raise ValueError("the table is empty")
    warning = f"{total - filtered} of {total} rows hold nulls and were left out" if filtered < 0.8 * total else None
    if warning:
        warnings.warn(warning, stacklevel=2)
    rows, n = df.where(complete), max(1, int(filtered * percent / 200))
    if low is not None and not gaps and filtered >= SKETCH:
        rows = rows.where((first <= F.lit(low).cast(kind)) | (first >= F.lit(high).cast(kind)))
    placed = with_ordinal(rows, keys)
    last = placed.agg(F.max(ORDINAL)).first()[0] or 0
    ends = placed.where((F.col(ORDINAL) <= n) | (F.col(ORDINAL) > last - n)).drop(ORDINAL).distinct()
    return Sample(ends, total, filtered, n, round(100 * (1 - filtered / total), 2) if filter_none and not filtered else 0.0, warning)


def _any_absent(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in df.columns:
        out = out | absent(df, c)
    return out


@dataclass
class KeyChoice:
    """``components`` identify a row if ``unique``; ``frame`` has them as text in column ``pk``."""

    frame: DataFrame
    name: str
    components: list[str]
    unique: bool
    warning: str | None = None


def key_text(columns: list[str]) -> Column:
    """Values joined by pipes, with backslashes and pipes escaped; null is the text null."""
    escaped = [F.coalesce(F.replace(F.replace(col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("null")) for c in columns]
    return F.concat_ws("|", *escaped)


#: Relative error of the sketches of distinct values, and how many of it a column may be off and still be counted exactly.
ERROR, SURE = 0.02, 5


def is_key(df: DataFrame, columns: list[str]) -> bool:
    """Whether the rows that are complete in ``columns`` differ in them. A sketch rules out most sets that don't, without a shuffle."""
    values = df.select(*(col(c) for c in columns))
    whole, key = values.where(~_any_absent(values)), F.struct(*(col(c) for c in columns))
    total, near = whole.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*(col(c) for c in columns)), ERROR)).first()
    if not total or near < (1 - SURE * ERROR) * total:
        return False
    return whole.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def key_profile(df: DataFrame, threshold: float) -> DataFrame:
    """A profile for ``infer_key``: distinct values by sketches, and exactly where these are near the threshold or over it."""
    rough = {r["column"]: r for r in profile(df, approximate=True).collect()}  # a row for each column
    high = [c for c, r in rough.items() if r["non_null_count"] and r["distinct_count"] >= (1 - SURE * ERROR) * threshold * r["non_null_count"]]
    low = df.sparkSession.createDataFrame([r.asDict() | {"is_unique": False} for c, r in rough.items() if c not in high], PROFILE)
    return low.unionByName(profile(df.select(*(col(c) for c in high)))) if high else low


def infer_key(df: DataFrame, found: DataFrame | None = None, threshold: float = 0.8, most: int = 5) -> KeyChoice:
    """The first unique column; else the most distinctive columns added one by one until they are unique, at most ``most``. Without a
    profile ``found``, columns under ``threshold`` are ranked by sketches of their distinct values."""
    if not df.columns:
        raise ValueError("a table without columns has no key")
    rows = {r["column"]: r for r in uniqueness(found if found is not None else key_profile(df, threshold)).collect()}  # one row per column
    for name in df.columns:
        if name in rows and rows[name]["is_unique"]:
            return KeyChoice(df.withColumn("pk", key_text([name])), "pk", [name], True)
    ratio = {c: rows[c]["uniqueness_ratio"] if c in rows else 0.0 for c in df.columns}
    ranked = sorted((c for c in df.columns if ratio[c] >= threshold), key=lambda c: (-ratio[c], c))
    parts = ranked[:1] or [df.columns[0]]
    dates = [c for c in df.columns if c in rows and rows[c]["is_datetime"] and c not in parts]
    rest = dates[:1] + [c for c in ranked if c not in parts + dates[:1]]
    rest += sorted((c for c in df.columns if c not in parts + rest), key=lambda c: (-ratio[c], c))
    if dates:
        parts.append(rest.pop(0))
    unique = is_key(df, parts)
    while not unique and rest and len(parts) < most:
        parts.append(rest.pop(0))
        unique = is_key(df, parts)
    warning = None if unique else f"no unique key of up to {most} columns; {parts} repeat"
    return KeyChoice(df.withColumn("pk", key_text(parts)), "_".join([*parts, "pk"]), parts, unique, warning)
