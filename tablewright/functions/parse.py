"""Text to typed values, null where a text is no such value. ANSI-safe; each is one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for true and false in casting, in policy coercion, and in strict coercion.
CAST_TRUE, CAST_FALSE = ("true", "yes", "y", "t", "1", "on"), ("false", "no", "n", "f", "0", "off")
BOOL_TRUE, BOOL_FALSE = ("true", "t", "1", "yes", "y", "on"), ("false", "f", "0", "no", "n", "off")
STRICT_TRUE, STRICT_FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
#: Characters that amounts may hold beside the number, and shapes of dates that aren't ISO.
CURRENCY = r"[$€£¥₹,\s]"
DATE_PATTERNS = ("dd/MM/yyyy", "yyyyMMdd", "MMM d yyyy")
#: Exact integers beyond what a double holds go by this type.
EXACT = T.DecimalType(38, 10)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def to_double(text: Column) -> Column:
    """As a number parser without type suffixes reads it; the words for NaN are null."""
    bare = F.trim(text)
    special = F.lower(bare).rlike("^[+-]?(inf|infinity|nan)$")
    number = F.when(special | ~bare.rlike("[dDfF]$"), bare.try_cast("double"))
    return F.when(~F.isnan(number), number)


def to_exact(text: Column) -> Column:
    return F.trim(text).try_cast(EXACT)


def strip_currency(text: Column) -> Column:
    return F.regexp_replace(text, CURRENCY, "")


def to_bool(text: Column, true: tuple[str, ...] = CAST_TRUE, false: tuple[str, ...] = CAST_FALSE) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def to_timestamp(text: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """ISO dates and times, then ``patterns`` in order. Times alone and short numbers are no dates."""
    bare = F.trim(text)
    iso = F.when(bare.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?$"), bare.try_cast("timestamp_ntz"))
    shapes = {"dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$", "yyyyMMdd": r"^\d{8}$", "MMM d yyyy": r"^[A-Za-z]{3} \d{1,2} \d{4}$"}
    others = [F.when(bare.rlike(shapes.get(p, ".")), F.try_to_timestamp(bare, F.lit(p)).cast("timestamp_ntz")) for p in patterns]
    return F.coalesce(iso, *others)


#: The end of an ISO time that says how far it is from UTC.
OFFSET = r"[ T]\d{1,2}:.*(Z|[+-]\d{1,2}(:?\d{2})?)$"


def to_utc(text: Column) -> Column:
    """As ``to_timestamp``; a time with an offset is moved to UTC, one without is UTC already."""
    bare = F.trim(text)
    # an instant, as the session's zone shows it, and back to UTC
    shown = F.when(bare.rlike(OFFSET), F.regexp_replace(bare, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    moved = F.to_utc_timestamp(shown, F.current_timezone()).cast("timestamp_ntz")
    return F.when(bare.rlike(OFFSET), moved).otherwise(to_timestamp(text))


def json_valid(text: Column) -> Column:
    """Whether a text is JSON; null for null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull() & (F.trim(text) != ""))


def bracketed(text: Column) -> Column:
    return text.rlike(r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$")
