"""CREATE TABLE text for five dialects, schema JSON, model source, and creation of snapshot tables with their data."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as I
from ..functions.clean import quick_clean
from ..functions.types import ForeignKey, TableSchema, schema_of
from ..operators import cast as casting
from ..operators import validate
from ..operators.profile import absent, col, infer_key
from ..sources import files
from ..sources.store import Store

VARCHAR = 255
#: SQL types by dialect. {n} is the length of text.
TYPES = {
    "oracle": {"text": "VARCHAR2({n})", "long": "NUMBER", "double": "BINARY_DOUBLE", "float": "BINARY_FLOAT", "boolean": "NUMBER(1,0)", "timestamp": "TIMESTAMP", "date": "DATE", "interval": "INTERVAL DAY TO SECOND", "object": "BLOB", "binary": "BLOB", "decimal": "NUMBER({p},{s})"},
    "sqlite": {"text": "TEXT", "long": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER", "timestamp": "DATETIME", "date": "DATE", "interval": "TEXT", "object": "BLOB", "binary": "BLOB", "decimal": "NUMERIC({p},{s})"},
    "mssql": {"text": "VARCHAR({n})", "long": "BIGINT", "double": "FLOAT", "float": "REAL", "boolean": "BIT", "timestamp": "DATETIME2", "date": "DATE", "interval": "VARCHAR(255)", "object": "VARBINARY(MAX)", "binary": "VARBINARY(MAX)", "decimal": "DECIMAL({p},{s})"},
    "mysql": {"text": "VARCHAR({n})", "long": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "TINYINT", "timestamp": "DATETIME", "date": "DATE", "interval": "VARCHAR(255)", "object": "JSON", "binary": "BLOB", "decimal": "DECIMAL({p},{s})"},
    "postgresql": {"text": "TEXT", "long": "BIGINT", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "interval": "INTERVAL", "object": "JSONB", "binary": "BYTEA", "decimal": "NUMERIC({p},{s})"},
}
#: Types of columns that are added to a table, where they differ from TYPES.
ADDED = {
    "oracle": {"long": "NUMBER(19)", "double": "NUMBER", "boolean": "NUMBER(1)", "object": "CLOB"},
    "sqlite": {"double": "FLOAT", "timestamp": "TEXT", "object": "TEXT"},
    "mssql": {"timestamp": "TIMESTAMP", "object": "TEXT"},
    "mysql": {"double": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"},
    "postgresql": {"timestamp": "TIMESTAMP WITH TIME ZONE"},
}
LONG_TEXT = {"oracle": "CLOB", "postgresql": "TEXT", "mssql": "VARCHAR(MAX)"}
#: How a column counts up by itself.
COUNTING = {
    "sqlite": "{c} INTEGER PRIMARY KEY AUTOINCREMENT",
    "mysql": "{c} BIGINT AUTO_INCREMENT",
    "mssql": "{c} BIGINT IDENTITY({n},1)",
    "postgresql": "{c} SERIAL",
    "oracle": "{c} NUMBER GENERATED ALWAYS AS IDENTITY (START WITH {n} INCREMENT BY 1)",
}


def family(kind: T.DataType) -> str:
    for name, kinds in (
        ("long", T.IntegralType), ("float", T.FloatType), ("decimal", T.DecimalType), ("double", T.FractionalType), ("boolean", T.BooleanType),
        ("date", T.DateType), ("timestamp", (T.TimestampType, T.TimestampNTZType)), ("interval", (T.DayTimeIntervalType, T.YearMonthIntervalType)),
        ("binary", T.BinaryType), ("object", (T.StructType, T.MapType, T.ArrayType, T.VariantType)),
    ):
        if isinstance(kind, kinds):
            return name
    return "text"


def sql_type(kind: T.DataType, server: str, length: int = VARCHAR, semantic: str | None = None) -> str:
    """``semantic``: what text holds, from cast.semantic_type; structured text is an object."""
    name = family(kind)
    if name == "text" and semantic in ("STRUCTURED_OBJECT", "TRUE_OBJECT"):
        name = "object"
    decimal = isinstance(kind, T.DecimalType)
    return TYPES[I.dialect_of(server)][name].format(n=length, p=kind.precision if decimal else 0, s=kind.scale if decimal else 0)


def added_type(kind: T.DataType, server: str, longest: int | None = None) -> str:
    """The type for a column that a table gets later; text by its longest value."""
    dialect, name = I.dialect_of(server), family(kind)
    if name != "text":
        return ADDED[dialect].get(name) or sql_type(kind, dialect)
    if longest is not None and longest > 4000:
        return LONG_TEXT.get(dialect, "TEXT")
    size = max(VARCHAR, longest or 0)
    return f"VARCHAR2({size})" if dialect == "oracle" else f"VARCHAR({size})"


def add_column_sql(table: str, name: str, type_text: str, server: str, schema: str | None = None) -> str:
    dialect = I.dialect_of(server)
    quoted = {"mysql": f"`{name}`", "mssql": f"[{name}]"}.get(dialect, f'"{name}"')
    return f"ALTER TABLE {f'{schema}.' if schema else ''}{table} ADD {'' if dialect in ('mssql', 'oracle') else 'COLUMN '}{quoted} {type_text}"


def longest_text(df: DataFrame) -> dict[str, int | None]:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.agg(*(F.max(F.length(col(c))).alias(c) for c in names)).first().asDict() if names else {}


@dataclass(frozen=True)
class Keys:
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    autoincrement: tuple[str, int] | None = None

    def renamed(self, names: dict[str, str]) -> Keys:
        new = lambda cols: tuple(names.get(c, c) for c in cols)
        auto = (names.get(self.autoincrement[0], self.autoincrement[0]), self.autoincrement[1]) if self.autoincrement else None
        return Keys(new(self.primary_key), tuple(map(new, self.unique)), tuple(ForeignKey(new(f.columns), f.table, f.references) for f in self.foreign_keys), auto)


def named(text: str, name: str, server: str) -> str:
    return text if I.dialect_of(server) == "sqlite" else f"CONSTRAINT {I.escape(I.constraint_name(name), server)} {text}"


def create_table_sql(struct: T.StructType, nullable: dict[str, bool], table: str, server: str, keys: Keys = Keys(), schema: str | None = None, lengths: dict[str, int] | None = None, semantics: dict[str, str] | None = None) -> str:
    """One CREATE TABLE statement. ``nullable``: whether a column holds nulls; one that doesn't is NOT NULL."""
    dialect, esc = I.dialect_of(server), lambda c: I.escape(c, server)
    auto = keys.autoincrement[0] if keys.autoincrement else None
    if auto and dialect == "sqlite" and keys.primary_key not in ((), (auto,)):
        raise ValueError("in sqlite a column that counts up is the primary key itself")
    lines = []
    for f in struct:
        if f.name == auto:
            lines.append(COUNTING[dialect].format(c=esc(f.name), n=keys.autoincrement[1]) + " NOT NULL")
            continue
        kind = sql_type(f.dataType, dialect, (lengths or {}).get(f.name, VARCHAR), (semantics or {}).get(f.name))
        lines.append(f"{esc(f.name)} {kind} {'NULL' if nullable.get(f.name, True) else 'NOT NULL'}")
    cols = lambda names: ", ".join(map(esc, names))
    if keys.primary_key and not (auto and dialect == "sqlite"):
        lines.append(named(f"PRIMARY KEY ({cols(keys.primary_key)})", f"{table}_PK", dialect))
    for i, fk in enumerate(keys.foreign_keys, 1):
        lines.append(named(f"FOREIGN KEY ({cols(fk.columns)}) REFERENCES {esc(fk.table)}({cols(fk.references)})", f"{table}_fk{i}", dialect))
    for i, u in enumerate(keys.unique, 1):
        lines.append(named(f"UNIQUE ({cols(u)})", f"{table}_uq{i}", dialect))
    name = f"{esc(schema)}.{esc(table)}" if schema else esc(table)
    return f"CREATE TABLE {name} (\n    " + ",\n    ".join(lines) + "\n)"


def facts(df: DataFrame) -> tuple[dict[str, bool], dict[str, str | None]]:
    """Whether each column holds nulls, and a value of each; one pass."""
    nullable, sample, _ = _facts(df)
    return nullable, sample


def _facts(df: DataFrame) -> tuple[dict[str, bool], dict[str, str | None], int]:
    each = [x for i, c in enumerate(df.columns) for x in (F.coalesce(F.bool_or(absent(df, c)), F.lit(False)).alias(f"n{i}"), F.min(col(c).cast("string")).alias(f"s{i}"))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *each).first()
    return {c: row[f"n{i}"] for i, c in enumerate(df.columns)}, {c: row[f"s{i}"] for i, c in enumerate(df.columns)}, row["rows"]


@dataclass
class Measured:
    """A frame, cast, and what DDL says of its data; the same for all dialects."""

    frame: DataFrame
    nullable: dict[str, bool]
    sample: dict[str, str | None]
    rows: int
    semantics: dict[str, str]

    def renamed(self, names: dict[str, str]) -> Measured:
        new = lambda d: {names.get(c, c): v for c, v in d.items()}
        return Measured(self.frame.toDF(*(names.get(c, c) for c in self.frame.columns)), new(self.nullable), new(self.sample), self.rows, new(self.semantics))


def measure(df: DataFrame, keys: Keys = Keys(), cast: bool = True) -> Measured:
    """Cast, check the keys, and measure all columns in two passes."""
    for key in (keys.primary_key, *keys.unique):
        if missing := [c for c in key if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")
    if cast:
        df = casting.cast_df(df)
    for key in (keys.primary_key, *keys.unique):
        if key and validate.has_duplicates(df.where(~_any(df, key)), key):
            raise ValueError(f"rows repeat {list(key)}")
    semantics = casting.semantic_types(df, [f.name for f in df.schema if family(f.dataType) == "text"])
    return Measured(df, *_facts(df), semantics)


def schema_json(df: DataFrame, table: str, server: str, keys: Keys = Keys(), names: dict[str, str] | None = None, known: Measured | None = None) -> dict:
    if known is None:
        known = Measured(df, *_facts(df), {})
    return {
        "table": table,
        "server": I.dialect_of(server),
        "columns": [{"name": f.name, "dtype": f.dataType.simpleString(), "sql": sql_type(f.dataType, server), "nullable": known.nullable[f.name], "sample": known.sample[f.name]} for f in df.schema],
        "primary_key": list(keys.primary_key),
        "unique": [list(u) for u in keys.unique],
        "foreign_keys": [{"columns": list(f.columns), "table": f.table, "references": list(f.references)} for f in keys.foreign_keys],
        "column_count": len(df.columns),
        "row_count": known.rows,
        "column_map": names or {c: c for c in df.columns},
    }


@dataclass
class Ddl:
    sql: str
    json: dict
    frame: DataFrame
    keys: Keys


def df_ddl(df: DataFrame, table: str, server: str = "oracle", keys: Keys = Keys(), schema: str | None = None, sanitize: bool = False, cast: bool = True, lengths: dict[str, int] | None = None, known: Measured | None = None) -> Ddl:
    """DDL for a frame. Names that SQL wouldn't take are an error, or with ``sanitize`` are changed, in the keys too. Keys must hold in the data.
    ``known``: what ``measure`` gave for the frame, to spare measuring it for each dialect."""
    names = {c: c for c in df.columns}
    if sanitize:
        names = dict(zip(df.columns, I.sanitize(df.columns, dialect=server), strict=True))
    elif bad := [c for c in df.columns if not c.isidentifier() or c.upper() in I.RESERVED[I.dialect_of(server)]]:
        raise ValueError(f"not fit for SQL names: {bad}")
    I.dialect_of(server)
    known, keys = (known or measure(df, keys, cast)).renamed(names), keys.renamed(names)
    sql = create_table_sql(known.frame.schema, known.nullable, table, server, keys, schema, lengths, known.semantics)
    return Ddl(sql, schema_json(known.frame, table, server, keys, names, known), known.frame, keys)


def _any(df: DataFrame, key):
    out = F.lit(False)
    for c in key:
        out = out | absent(df, c)
    return out


@dataclass
class Created:
    server: str
    status: str
    sql: str = ""
    rows: int = 0
    error: str | None = None


def table_schema(made: Ddl) -> TableSchema:
    """The schema of the table that DDL makes. A column that counts up gives numbers to rows without one when they are inserted."""
    schema = schema_of(made.frame.schema, made.keys.primary_key, made.keys.unique, made.keys.foreign_keys)
    auto = made.keys.autoincrement
    counting = lambda c: replace(c, type="bigint", tag="identity", start=auto[1], has_server_default=True, default=None)
    return replace(schema, columns=tuple(counting(c) if auto and c.name == auto[0] else c for c in schema.columns))


def create_and_load(store: Store, df: DataFrame, table: str, servers: list[str], keys: Keys | None = None, sanitize: bool = True, if_exists: str = "replace") -> list[Created]:
    """DDL for each dialect, and one table with the rows, named and typed as for the first dialect that works; the data are measured and
    written once. Without keys the primary key is inferred."""
    out: list[Created] = []
    try:
        own = keys if keys is not None else Keys(tuple(k.components) if (k := infer_key(df)).unique else ())
        known = measure(df, own)
    except ValueError as e:
        return [Created(server, "failed", error=str(e)) for server in servers]
    loaded = False
    for server in servers:
        try:
            made = df_ddl(df, table, server, own, sanitize=sanitize, known=known)
            if not loaded:
                store.create(table, table_schema(made), made.frame, if_exists)
                loaded = True
            out.append(Created(server, "created", made.sql, known.rows))
        except ValueError as e:
            out.append(Created(server, "failed", error=str(e)))
    return out


def csv_create_and_load(store: Store, path: str, table: str, servers: list[str], keys: Keys | None = None, clean: bool = True, save_back: bool = False, folder: str | None = None, if_exists: str = "replace") -> list[Created]:
    """``create_and_load`` from a CSV file. ``save_back``: write the table's rows over the file. ``folder``: where the schema's JSON goes, for each dialect."""
    df = files.read_csv(store.spark, path)
    df = quick_clean(df) if clean else df
    if keys is not None and clean:
        keys = keys.renamed({c: n for c, n in zip(files.read_csv(store.spark, path).columns, df.columns, strict=True)})
    out = create_and_load(store, df, table, servers, keys, if_exists=if_exists)
    made = [c for c in out if c.status == "created"]
    if made and save_back:
        files.overwrite_csv(store.read(table), path)
    for c in made if folder else ():
        files.write_schema_json(store.spark, folder, c.server, table, schema_json(store.read(table), table, c.server, keys or Keys(store.primary_key(table))))
    return out


def model_source(struct: T.StructType, table: str, keys: Keys = Keys(), nullable: dict[str, bool] | None = None) -> str:
    """Source of a declarative model class, as text."""
    kinds = {"text": "String(255)", "long": "BigInteger", "double": "Float", "float": "Float", "decimal": "Numeric", "boolean": "Boolean", "timestamp": "DateTime", "date": "Date", "interval": "Interval", "object": "JSON", "binary": "LargeBinary"}
    used = sorted({kinds[family(f.dataType)].partition("(")[0] for f in struct})
    lines = [f"from sqlalchemy import Column, {', '.join(used)}", "from sqlalchemy.orm import declarative_base", "", "Base = declarative_base()", "", "", f"class {''.join(p.capitalize() for p in I.normalize(table).split('_')) or 'Model'}(Base):", f'    __tablename__ = "{table}"', ""]
    for f in struct:
        extra = ", primary_key=True" if f.name in keys.primary_key else f", nullable={(nullable or {}).get(f.name, f.nullable)}"
        extra += ", unique=True" if (f.name,) in keys.unique else ""
        lines.append(f"    {f.name} = Column({kinds[family(f.dataType)]}{extra})")
    return "\n".join(lines) + "\n"


@dataclass(frozen=True)
class FrameSchema:
    """What a frame suggests for a table: SQL text of a column's type by dialect."""

    columns: dict[str, str] = field(default_factory=dict)


def frame_schema(df: DataFrame, server: str) -> FrameSchema:
    """Types by data: text whose values are all dates is a timestamp; text of up to 255 characters is VARCHAR, longer is TEXT."""
    targets, longest = casting.infer(df), longest_text(df)
    out = {}
    for f in df.schema:
        kind = T.TimestampNTZType() if targets.get(f.name) == "timestamp" else f.dataType
        long = family(kind) == "text" and (longest.get(f.name) or 0) > VARCHAR
        out[f.name] = LONG_TEXT.get(I.dialect_of(server), "TEXT") if long else sql_type(kind, server)
    return FrameSchema(out)
