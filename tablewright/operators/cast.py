"""Type inference and casting of text columns: one pass measures all columns, the driver decides, one select applies.

Inference looks at all rows, so its result depends neither on row order nor on how rows are split.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from .profile import col

#: Parts of names that suggest a date.
DATE_NAMES = ("date", "time", "timestamp", "_at", "created", "updated")
#: Patterns by type, in the order in which they are tried on whole values.
PATTERNS = {
    "timestamp": [r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"],
    "date": [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"],
    "boolean": [r"true|false", r"yes|no", r"y|n"],
    "integer": [r"-?\d+"],
    "float": [r"-?\d*\.?\d+", r"-?\d*\.?\d*[eE][+-]?\d+"],
}
#: Patterns of amounts without their currency.
INTEGER, NUMBER = r"^-?\d+$", r"^-?\d*\.?\d+([eE][-+]?\d+)?$"


@dataclass(frozen=True)
class CastConfig:
    """``threshold``: share of values that must look like a type. ``max_null_increase``: share of rows that may become null."""

    threshold: float = 0.9
    confidence: float = 0.7
    max_null_increase: float = 0.1
    by_column: bool = False


FAST, SAFE = CastConfig(), CastConfig(threshold=0.95, max_null_increase=0.05)


def to_frame(spark: SparkSession, data) -> DataFrame:
    """A DataFrame as it is; a dict of scalars as one row; a dict of lists as columns; a list of dicts as rows."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        if data and all(isinstance(v, (list, tuple)) for v in data.values()):
            return spark.createDataFrame(list(zip(*data.values(), strict=True)), list(data))
        return spark.createDataFrame([data])
    if isinstance(data, (list, tuple)) and data and all(isinstance(x, dict) for x in data):
        return spark.createDataFrame(list(data))
    raise TypeError(f"not tabular: {type(data).__name__}")


def inferred(text: Column) -> Column:
    """The type that a value looks like."""
    out = F.lit("string")
    for name, patterns in reversed(PATTERNS.items()):
        out = F.when(F.lower(text).rlike("^(" + "|".join(patterns) + ")$"), F.lit(name)).otherwise(out)
    return out


def numeric(text: Column, integral: bool) -> Column:
    bare = parse.strip_currency(text)
    return parse.to_exact(bare).cast("long") if integral else parse.to_double(bare)


def semantic_types(df: DataFrame, names: Iterable[str], threshold: float = 0.9) -> dict[str, str]:
    """What columns of objects hold: strings, structures (JSON), or other objects. All null: strings. One pass for all columns."""
    kinds = {c: df.schema[c].dataType for c in names}
    text = [c for c, k in kinds.items() if parse.is_string(k)]
    shares = df.agg(*(F.avg(F.when(col(c).isNotNull(), (parse.bracketed(col(c)) & parse.json_valid(col(c))).cast("int"))).alias(c) for c in text)).first() if text else {}
    out = {}
    for c, kind in kinds.items():
        if c in text:
            out[c] = "STRUCTURED_OBJECT" if shares[c] is not None and shares[c] >= threshold else "STRING_OBJECT"
        else:
            out[c] = "STRUCTURED_OBJECT" if isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)) else "TRUE_OBJECT"
    return out


def semantic_type(df: DataFrame, name: str, threshold: float = 0.9) -> str:
    return semantic_types(df, [name], threshold)[name]


def sample_values(df: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """Up to ``most`` values that aren't null, the same ones for the same values, in any order of rows: those of the smallest digests."""
    return df.where(col(name).isNotNull()).select(col(name)).orderBy(F.md5(col(name).cast("string").cast("binary")), col(name)).limit(most)


def measures(name: str, text: Column) -> dict[str, Column]:
    """Shares over non-null values (null where there are none), and null counts before and after each conversion."""
    share = lambda test: F.avg(F.when(text.isNotNull(), test.cast("int")))
    bare = parse.strip_currency(text)
    out = {
        "number": share(bare.rlike(NUMBER)),
        "integer": share(bare.rlike(INTEGER)),
        "bool": share(F.lower(F.trim(text)).isin(*parse.CAST_TRUE, *parse.CAST_FALSE)),
        "json": share(parse.bracketed(text) & F.coalesce(parse.json_valid(text), F.lit(False))),
        "null": F.avg(text.isNull().cast("int")),
        "no_date": F.avg(parse.to_timestamp(text).isNull().cast("int")),
        "no_double": F.avg(numeric(text, False).isNull().cast("int")),
        "no_long": F.avg(numeric(text, True).isNull().cast("int")),
        "no_bool": F.avg(parse.to_bool(text).isNull().cast("int")),
    }
    kind = inferred(text)
    for k in (*PATTERNS, "string"):
        out[f"is_{k}"] = share(kind == k)
    return out


def decide(name: str, m: dict, config: CastConfig) -> str:
    """Of text, timestamp, long, double and boolean, what the column becomes."""
    fits = lambda key: m[key] is not None and m[key] - m["null"] <= config.max_null_increase + 1e-12
    if m["number"] is None:
        return "text"
    number = "long" if m["integer"] == 1.0 else "double"
    if config.by_column:
        kinds = {k: m[f"is_{k}"] for k in (*PATTERNS, "string")}
        best = max(kinds, key=kinds.get)
        if kinds[best] > config.confidence and best != "string":
            target = {"timestamp": "timestamp", "date": "timestamp", "boolean": "boolean", "integer": "long", "float": "double"}[best]
            return target if fits({"timestamp": "no_date", "boolean": "no_bool", "long": "no_long", "double": "no_double"}[target]) else "text"
        if m["number"] >= config.threshold and fits("no_double"):
            return number
        return "timestamp" if 1 - m["no_date"] >= config.threshold and fits("no_date") else "text"
    if any(k in name.lower() for k in DATE_NAMES) and m["json"] < config.threshold:
        return "timestamp" if fits("no_date") else "text"
    if m["number"] > config.threshold:
        return number if fits(f"no_{number}") else "text"
    return "boolean" if m["bool"] >= config.threshold else "text"


def converted(text: Column, target: str) -> Column:
    return {"text": lambda: text, "timestamp": lambda: parse.to_timestamp(text), "long": lambda: numeric(text, True),
            "double": lambda: numeric(text, False), "boolean": lambda: parse.to_bool(text)}[target]()


def infer(df: DataFrame, config: CastConfig = CastConfig(), skip: dict | None = None) -> dict[str, str]:
    """What each text column that isn't in ``skip`` becomes."""
    names = [f.name for f in df.schema if parse.is_string(f.dataType) and f.name not in (skip or {})]
    if not names:
        return {}
    aggs = [m.alias(f"{i}_{k}") for i, c in enumerate(names) for k, m in measures(c, col(c)).items()]
    row = df.agg(*aggs).first().asDict()
    return {c: decide(c, {k.partition("_")[2]: v for k, v in row.items() if k.partition("_")[0] == str(i)}, config) for i, c in enumerate(names)}


def cast_df(df: DataFrame, dtype: dict[str, str] | None = None, config: CastConfig = CastConfig()) -> DataFrame:
    """``df`` with its text columns cast to what they hold. ``dtype`` names types for columns, which are then not inferred."""
    targets = infer(df, config, dtype)
    fixed = {c: col(c).try_cast(t) for c, t in (dtype or {}).items()}
    return df.withColumns({c: converted(col(c), t) for c, t in targets.items() if t != "text"} | fixed)


def auto_cast(df: DataFrame, **options) -> DataFrame:
    return cast_df(df, config=replace(CastConfig(), **options))


def fast_cast(df: DataFrame) -> DataFrame:
    return cast_df(df, config=FAST)


def safe_cast(df: DataFrame) -> DataFrame:
    return cast_df(df, config=SAFE)
