"""Correction of a frame for a target table, by policy: measure everything in one pass, decide, apply in one select.

``correct`` follows policies for each column and checks constraints. ``align`` is strict about types and lenient about a
share of failures. ``conform`` keeps or drops whole columns by whether they cast without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..functions.types import REGISTRY, ColumnSpec, Constraints, Logical, TableSchema
from . import coerce as C
from . import mapping, outliers, validate
from .profile import absent, col


class CorrectionError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Policy:
    """``outliers``: None, or ``iqr`` (3 times the range, at least 8 values). ``utc``: times with an offset are moved to UTC, others are
    taken as UTC; ``naive``: the result has no zone."""

    on_error: C.OnError = C.OnError.RAISE
    max_failure_rate: float = 0.0
    on_length: C.OnLength = C.OnLength.RAISE
    outliers: str | None = None
    logical: Logical | None = None
    utc: bool = True
    naive: bool = True


#: Fails nothing: bad values become null.
COERCE = Policy(C.OnError.COERCE)
#: Bad values of a column that are reported.
SAMPLES = 5


@dataclass
class ColumnReport:
    column: str
    action: str
    rows: int
    failures: int
    decision: str
    samples: list[str] = field(default_factory=list)

    @property
    def failure_rate(self) -> float:
        return self.failures / self.rows if self.rows else 0.0


@dataclass
class Report:
    columns: list[ColumnReport] = field(default_factory=list)
    mapping: mapping.Mapping | None = None
    added: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _measured(df: DataFrame, coerced: dict[str, C.Coerced], samples: int = SAMPLES) -> dict[str, tuple[int, int, list[str]]]:
    """(rows, failures, samples of failing raw values) by column, in one pass. The samples are the smallest of those that hash to different
    places, so their number is fixed, and the same rows give the same ones."""
    if not coerced:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, c) in enumerate(coerced.items()):
        bad = F.when(c.failed, col(name).cast("string"))
        place = F.pmod(F.xxhash64(bad), F.lit(2 * samples))
        some = [F.min(F.when(place == k, bad)) for k in range(2 * samples)]
        aggs += [F.count_if(c.failed).alias(f"f{i}"), F.slice(F.array_distinct(F.array_compact(F.array(F.min(bad), F.max(bad), *some))), 1, samples).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {name: (row["rows"], row[f"f{i}"], list(row[f"s{i}"])) for i, name in enumerate(coerced)}


def decision(failures: int, rows: int, policy: Policy) -> str:
    if not failures:
        return "none"
    if policy.on_error is C.OnError.RAISE and failures > policy.max_failure_rate * rows:
        return "raise"
    return "keep" if policy.on_error is C.OnError.REPORT else "null"


def correct(
    df: DataFrame,
    schema: TableSchema,
    policy: Policy = Policy(),
    by_column: dict[str, Policy] | None = None,
    explicit: dict[str, str] | None = None,
    target: DataFrame | None = None,
    parents: dict[str, DataFrame] | None = None,
    evolve: bool = False,
) -> tuple[DataFrame, Report]:
    """Map, coerce and check. Values of the result are those that the target takes. With RAISE, all errors at once."""
    report = Report()
    found = mapping.by_name(df.columns, [c.name for c in schema.columns if c.writeable], explicit)
    if evolve and found.dropped:
        more = [added_spec(df, c) for c in found.dropped]
        schema, report.added = schema.with_columns(*more), [c.name for c in more]
        found = mapping.by_name(df.columns, [c.name for c in schema.columns if c.writeable], explicit)
    report.mapping = found
    df = mapping.apply(df, found)
    report.errors += [f"missing column {c}" for c in validate.required_missing(df.columns, schema)]
    policies = {c: (by_column or {}).get(c, policy) for c in df.columns}
    specs = {c: schema[c] if policies[c].logical is None else replace(schema[c], logical=policies[c].logical) for c in df.columns}
    watched = [c for c in df.columns if policies[c].outliers and specs[c].logical in (Logical.INTEGER, Logical.DECIMAL)]
    numbers = df.select(*(C.number(col(c), df.schema[c].dataType).alias(c) for c in watched))
    bounds = outliers.bounds_of(numbers, {c: (policies[c].outliers, 3.0, 8) for c in watched}) if watched else {}
    coerced = {}
    for name in df.columns:
        p, kind = policies[name], df.schema[name].dataType
        coerced[name] = C.coerce(col(name), kind, specs[name], bounds.get(name, outliers.NONE), p.on_length, p.utc, p.naive)
    values = {}
    for name, (rows, failures, bad) in _measured(df, coerced).items():
        what = decision(failures, rows, policies[name])
        report.columns.append(ColumnReport(name, coerced[name].action, rows, failures, what, bad))
        if what == "raise":
            report.errors.append(f"{name}: {failures} of {rows} values fail, such as {bad}")
        value = coerced[name].value
        values[name] = value if what in ("none", "keep") else F.when(~coerced[name].failed, value)
    df = df.select(*(values[c].alias(c) for c in df.columns))
    report.errors += constraint_errors(df, schema, target, parents)
    if policy.on_error is C.OnError.RAISE and report.errors:
        raise CorrectionError(report.errors)
    return df, report


def constraint_errors(df: DataFrame, schema: TableSchema, target: DataFrame | None, parents: dict[str, DataFrame] | None) -> list[str]:
    out = [f"{c}: {n} nulls" for c, n in validate.null_counts(df, schema).items()]
    for key in schema.key_sets():
        if all(c in df.columns for c in key):
            if n := validate.duplicate_rows(df, key):
                out.append(f"{n} rows repeat {list(key)}")
            if target is not None and (n := validate.already_there(df, target, key).count()):
                out.append(f"{n} keys {list(key)} are in the table already")
    for fk in schema.constraints.foreign_keys:
        if fk.table in (parents or {}) and all(c in df.columns for c in fk.columns) and (n := validate.orphans(df, parents[fk.table], fk).count()):
            out.append(f"{n} keys {list(fk.columns)} are not in {fk.table}")
    return out


def added_spec(df: DataFrame, name: str) -> ColumnSpec:
    """The column that a table gets for a source column that it lacks: by type, or for text by what nearly all values are."""
    from ..functions.identifiers import normalize

    kind, target = df.schema[name].dataType, normalize(name) or "col_0"
    if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ColumnSpec(target, REGISTRY.logical(kind), kind.simpleString())
    text = col(name).cast("string")
    double = parse.to_double(text)
    share, whole, longest = df.agg(F.avg(F.when(text.isNotNull(), double.isNotNull().cast("int"))), F.bool_and(F.pmod(double, F.lit(1.0)) == 0), F.max(F.length(text))).first()
    if share is not None and share > 0.98:
        return ColumnSpec(target, Logical.INTEGER, "bigint") if whole else ColumnSpec(target, Logical.DECIMAL, "decimal(38,10)", precision=38, scale=10)
    return ColumnSpec(target, Logical.STRING, "string", length=255 if longest is None or longest <= 255 else None)


# Strict alignment


def threshold_of(value: float | None) -> float:
    """A share: None is 0.02, over 1 is a percentage, under 0 is 0."""
    if value is None:
        return 0.02
    return max(0.0, value / 100 if value > 1 else value)


def strict(raw, kind: T.DataType, spec: ColumnSpec) -> C.Coerced:
    if spec.logical is Logical.INTEGER:
        return C.integer(raw, kind, tolerance=1e-9)
    if spec.logical is Logical.BOOL:
        return C.boolean(raw, kind, strict=True)
    if spec.logical is Logical.DECIMAL and spec.precision is None:
        return C.double(raw, kind)
    return C.coerce(raw, kind, spec)


def align(
    df: DataFrame,
    schema: TableSchema,
    on_error: str = "coerce",
    failure_threshold: float | None = None,
    strict_mode: bool = True,
    explicit: dict[str, str] | None = None,
    add_missing: bool = False,
    outlier_method: str | None = None,
    fill_missing: bool = False,
) -> DataFrame:
    """Columns by name in any case, strictly coerced, in the table's order. Up to ``failure_threshold`` of a column's values may
    fail and become null; beyond it, strict mode raises unless all further failures are outliers that ``outlier_method`` excuses."""
    limit = threshold_of(failure_threshold)
    raising = on_error == "raise" or strict_mode and on_error == "coerce"
    df = mapping.rename(df, mapping.ignoring_case(df.columns, schema.names, explicit))
    if add_missing:
        schema = schema.with_columns(*(added_spec(df, c) for c in df.columns if c not in schema.names))
        df = mapping.rename(df, mapping.ignoring_case(df.columns, schema.names, {}))
    df = mapping.in_order(df, schema.names, fill=False)
    coerced = {c: strict(col(c), df.schema[c].dataType, schema[c]) for c in df.columns}
    measured = _measured(df, coerced)
    over = {c for c, (rows, failures, _) in measured.items() if rows and failures / rows > limit and raising}
    excused = _excused(df, {c: coerced[c] for c in over if schema[c].logical in (Logical.INTEGER, Logical.DECIMAL)}, outlier_method) if outlier_method else {}
    errors, values = [], {}
    for name, (rows, failures, bad) in measured.items():
        if name in over and (failures - excused.get(name, 0)) / rows > limit:
            errors.append(f"{name}: {failures} of {rows} values fail, such as {bad}")
        if schema[name].length is not None and schema[name].logical is Logical.STRING and failures and strict_mode:
            errors.append(f"{name}: {failures} texts are longer than {schema[name].length}")
        values[name] = F.when(~coerced[name].failed, coerced[name].value)
    out = df.select(*(values[c].alias(c) for c in df.columns))
    rows = {c.name: c for c in schema.columns if not c.nullable and c.name in out.columns}
    if rows:
        share = out.agg(*(F.avg(absent(out, c).cast("int")).alias(c) for c in rows)).first()
        errors += [f"{c}: {share[c]:.1%} nulls" for c in rows if (share[c] or 0) > limit]
    for key in schema.key_sets():
        if strict_mode and all(c in out.columns for c in key) and validate.has_duplicates(out, key):
            errors.append(f"rows repeat {list(key)}")
    if errors:
        raise CorrectionError(errors)
    return mapping.in_order(out, schema.names, {c.name: c.type for c in schema.columns}, fill_missing)


def _excused(df: DataFrame, coerced: dict[str, C.Coerced], method: str) -> dict[str, int]:
    """Failing values that are numbers, but outliers, by column; all columns in the same passes."""
    numbers = df.select(*(C.number(col(c), df.schema[c].dataType).alias(c) for c in coerced), *(x.failed.alias(f"__failed_{c}") for c, x in coerced.items()))
    if not coerced:
        return {}
    found = outliers.bounds_of(numbers, {c: (method, None, 4) for c in coerced})
    row = numbers.agg(*(F.count_if(F.col(f"`__failed_{c}`") & found[c].outside(col(c))).alias(c) for c in coerced)).first()
    return row.asDict()


# Whole-column conformity


@dataclass
class Conformity:
    """``failed``: columns that became null as a whole, or whose share of new nulls is over the threshold (in percent).
    ``corrected``: values that became null as outliers, by column."""

    status: str
    failed: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    introduced_nulls_pct: dict[str, float] = field(default_factory=dict)
    corrected: dict[str, int] = field(default_factory=dict)


def whole(raw, kind: T.DataType, spec: ColumnSpec) -> C.Coerced:
    """A cast that takes no words for booleans: those are booleans, or numbers 1 and 0."""
    if spec.logical is Logical.BOOL and parse.is_string(kind):
        return C.Coerced(F.lit(None).cast("boolean"), raw.isNotNull(), "bool")
    if spec.logical is Logical.STRING:
        return C.string(raw)
    return C.integer(raw, kind) if spec.logical is Logical.INTEGER else strict(raw, kind, spec)


def conform(
    df: DataFrame, schema: TableSchema | None, threshold: float = 5.0, strict_mode: bool = True, auto_alter: bool = False, fix_outliers: str | None = None
) -> tuple[DataFrame, Conformity, TableSchema | None]:
    """A column that any value keeps from casting becomes null as a whole. Missing columns are null. Without a table, ``df`` as it is.
    ``fix_outliers`` is for numbers that don't cast reliably: of these, values that fail and outliers become null, and not the whole
    column. Columns that cast reliably keep all their values."""
    if schema is None:
        return df, Conformity("table not found"), None
    report = Conformity("aligned")
    df = mapping.rename(df, mapping.ignoring_case(df.columns, schema.names))
    if auto_alter:
        more = [added_spec(df, c) for c in df.columns if c not in schema.names]
        schema, report.added = schema.with_columns(*more), [c.name for c in more]
        df = mapping.rename(df, mapping.ignoring_case(df.columns, schema.names))
    present = [c for c in schema.names if c in df.columns]
    coerced = {c: whole(col(c), df.schema[c].dataType, schema[c]) for c in present}
    measured = _measured(df, coerced)
    unsure = [c for c in present if measured[c][1] and fix_outliers and schema[c].logical in (Logical.INTEGER, Logical.DECIMAL)]
    numbers = df.select(*(coerced[c].value.alias(c) for c in unsure))
    found = outliers.bounds_of(numbers, {c: (fix_outliers, None, 4) for c in unsure}) if unsure else {}
    values = {c: F.lit(None).cast(schema[c].type) for c in schema.names}
    for c in present:
        if not measured[c][1]:
            values[c] = coerced[c].value
        elif c in found:
            values[c] = F.when(~found[c].outside(coerced[c].value), coerced[c].value)
    out = df.select(*(values[c].alias(c) for c in schema.names))
    if present:
        before = df.agg(*(F.avg(absent(df, c).cast("int")).alias(c) for c in present)).first()
        after = out.agg(*(F.avg(absent(out, c).cast("int")).alias(c) for c in present)).first()
        report.introduced_nulls_pct = {c: 100 * ((after[c] or 0) - (before[c] or 0)) for c in present}
        report.failed = [c for c, v in report.introduced_nulls_pct.items() if v > threshold]
    if unsure:
        report.corrected = numbers.agg(*(F.count_if(found[c].outside(col(c))).alias(c) for c in unsure)).first().asDict()
    if report.failed and strict_mode:
        raise CorrectionError([f"{c}: {report.introduced_nulls_pct[c]:.1f} % new nulls" for c in report.failed])
    return out, report, schema


def constraints_of(primary_key=(), unique=(), foreign_keys=()) -> Constraints:
    return Constraints(tuple(primary_key), tuple(map(tuple, unique)), tuple(foreign_keys))
