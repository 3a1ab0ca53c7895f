"""Coercion of a column to a logical type, as a value and a failure flag. Both are expressions; nothing runs here."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..functions.types import ColumnSpec, Logical
from .outliers import NONE, Bounds


class OnError(str, Enum):
    RAISE = "raise"
    REPORT = "report"
    COERCE = "coerce"


class OnLength(str, Enum):
    RAISE = "raise"
    TRUNCATE = "truncate"
    NULL = "null"


@dataclass(frozen=True)
class Coerced:
    """``failed`` is never null."""

    value: Column
    failed: Column
    action: str


def _of(raw: Column, value: Column, action: str, also: Column | None = None) -> Coerced:
    failed = raw.isNotNull() & value.isNull()
    return Coerced(value, F.coalesce(failed if also is None else failed | also, F.lit(False)), action)


def number(raw: Column, kind: T.DataType) -> Column:
    return parse.to_double(raw) if parse.is_string(kind) else raw.cast("double")


def integer(raw: Column, kind: T.DataType, bounds: Bounds = NONE, tolerance: float = 0.0) -> Coerced:
    """Whole numbers, rounded half to even; fractions and outliers fail. Numbers beyond 2**53 keep all digits."""
    if isinstance(kind, T.IntegralType):
        return _of(raw, raw.cast("long"), "integer", bounds.outside(raw))
    double = number(raw, kind)
    exact = parse.to_exact(raw).cast("long") if parse.is_string(kind) else F.lit(None).cast("long")
    rest = F.pmod(double, F.lit(1.0))
    whole = (rest == 0) if not tolerance else (rest <= tolerance)
    rounded = F.when(F.abs(double) < 9.0e15, F.bround(double, 0).cast("long"))
    return _of(raw, F.when(whole, F.coalesce(rounded, exact)), "integer", bounds.outside(double))


def decimal(raw: Column, kind: T.DataType, precision: int = 38, scale: int = 10, bounds: Bounds = NONE) -> Coerced:
    """Decimal, half up to the scale; too many digits fail."""
    text = F.trim(raw) if parse.is_string(kind) else raw
    return _of(raw, text.try_cast(T.DecimalType(precision, scale)), "decimal", bounds.outside(number(raw, kind)))


def double(raw: Column, kind: T.DataType) -> Coerced:
    return _of(raw, number(raw, kind), "float")


def string(raw: Column, length: int | None = None, on_length: OnLength = OnLength.RAISE) -> Coerced:
    """Text. Longer than ``length``: a failure, or cut, or null, which are none."""
    text = raw.cast("string")
    if length is None:
        return Coerced(text, F.lit(False), "string")
    long = F.coalesce(F.length(text) > length, F.lit(False))
    if on_length is OnLength.TRUNCATE:
        return Coerced(F.substring(text, 1, length), F.lit(False), "truncate")
    if on_length is OnLength.NULL:
        return Coerced(F.when(~long, text), F.lit(False), "null")
    return Coerced(F.when(~long, text), long, "string")


def boolean(raw: Column, kind: T.DataType, strict: bool = False) -> Coerced:
    """Words for true and false; numbers 1 and 0. Strictly, text such as 1.0, t and f fails."""
    if isinstance(kind, T.BooleanType):
        return Coerced(raw, F.lit(False), "bool")
    if isinstance(kind, T.NumericType):
        return _of(raw, F.when(raw == 1, True).when(raw == 0, False), "bool")
    words = (parse.STRICT_TRUE, parse.STRICT_FALSE) if strict else (parse.BOOL_TRUE, parse.BOOL_FALSE)
    value = parse.to_bool(raw.cast("string"), *words)
    if not strict:
        n = parse.to_double(raw.cast("string"))
        value = F.coalesce(value, F.when(n == 1, True).when(n == 0, False))
    return _of(raw, value, "bool")


def timestamp(raw: Column, kind: T.DataType, utc: bool = False, naive: bool = True) -> Coerced:
    """Each value by the first of the known shapes that fits it. ``utc``: times with an offset are moved to UTC, those without are UTC.
    The result is without a zone if ``naive``, else an instant."""
    if parse.is_string(kind):
        value = parse.to_utc(raw) if utc else parse.to_timestamp(raw)
    elif isinstance(kind, T.TimestampType) and utc:
        value = F.to_utc_timestamp(raw, F.current_timezone()).cast("timestamp_ntz")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = raw.cast("timestamp_ntz")
    else:
        value = F.lit(None).cast("timestamp_ntz")
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), value).cast("timestamp")
    return _of(raw, value if naive else instant, "datetime")


def json_text(raw: Column, kind: T.DataType) -> Coerced:
    """Normal JSON text; blank text and JSON null fail."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return Coerced(F.to_json(raw), F.lit(False), "json")
    if not parse.is_string(kind):
        return _of(raw, F.lit(None).cast("string"), "json")
    variant = F.when(F.trim(raw) != "", F.try_parse_json(raw))
    return _of(raw, F.when(~F.is_variant_null(variant), F.to_json(variant)), "json")


def binary(raw: Column, kind: T.DataType) -> Coerced:
    if isinstance(kind, T.BinaryType):
        return Coerced(raw, F.lit(False), "binary")
    return _of(raw, F.lit(None).cast("binary"), "binary")


def coerce(raw: Column, kind: T.DataType, spec: ColumnSpec, bounds: Bounds = NONE, on_length: OnLength = OnLength.RAISE, utc: bool = False, naive: bool = True) -> Coerced:
    """By the logical type of a target column."""
    if spec.logical is Logical.INTEGER:
        return integer(raw, kind, bounds)
    if spec.logical is Logical.DECIMAL:
        if spec.type in ("double", "float"):
            found = double(raw, kind)
            return Coerced(found.value, found.failed | bounds.outside(found.value), found.action)
        return decimal(raw, kind, spec.precision or 38, spec.scale if spec.scale is not None else 10, bounds)
    if spec.logical is Logical.BOOL:
        return boolean(raw, kind)
    if spec.logical is Logical.DATETIME:
        return timestamp(raw, kind, utc, naive)
    if spec.logical is Logical.JSON:
        return json_text(raw, kind)
    if spec.logical is Logical.BINARY:
        return binary(raw, kind)
    return string(raw, spec.length, on_length)
