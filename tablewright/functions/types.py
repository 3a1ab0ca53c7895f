"""Table schemas: logical types, column specs and constraints, and their form as a StructType and as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T


class Logical(str, Enum):
    INTEGER = "integer"
    DECIMAL = "decimal"
    STRING = "string"
    BOOL = "bool"
    DATETIME = "datetime"
    JSON = "json"
    BINARY = "binary"
    OTHER = "other"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    logical: Logical
    type: str = "string"
    nullable: bool = True
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    default: object = None
    tag: str | None = None
    writeable: bool = True
    has_server_default: bool = False
    #: Of a column with the tag ``identity``: the first number that rows without one get.
    start: int = 1


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Constraints:
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnSpec, ...]
    constraints: Constraints = field(default_factory=Constraints)

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name.lower() == name.lower())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def key_sets(self) -> list[tuple[str, ...]]:
        """The primary key and the unique sets, without empty ones."""
        return [k for k in (self.constraints.primary_key, *self.constraints.unique) if k]

    def with_columns(self, *more: ColumnSpec) -> TableSchema:
        return replace(self, columns=(*self.columns, *more))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, default=str)

    @staticmethod
    def from_json(text: str) -> TableSchema:
        d = json.loads(text)
        c = d["constraints"]
        return TableSchema(
            tuple(ColumnSpec(**x | {"logical": Logical(x["logical"])}) for x in d["columns"]),
            Constraints(
                tuple(c["primary_key"]),
                tuple(map(tuple, c["unique"])),
                tuple(ForeignKey(tuple(f["columns"]), f["table"], tuple(f["references"])) for f in c["foreign_keys"]),
            ),
        )


Rule = tuple[Callable[[T.DataType], bool], Logical]


class TypeRegistry:
    """DataType -> logical type: the first rule that fits decides; rules that are registered later come first."""

    def __init__(self):
        kinds = lambda *k: lambda x: isinstance(x, k)
        self.rules: list[Rule] = [
            (kinds(T.IntegralType), Logical.INTEGER),
            (kinds(T.FractionalType), Logical.DECIMAL),
            (kinds(T.StringType), Logical.STRING),
            (kinds(T.BooleanType), Logical.BOOL),
            (kinds(T.DateType, T.TimestampType, T.TimestampNTZType), Logical.DATETIME),
            (kinds(T.VariantType, T.StructType, T.MapType, T.ArrayType), Logical.JSON),
            (kinds(T.BinaryType), Logical.BINARY),
        ]

    def register(self, fits: Callable[[T.DataType], bool], logical: Logical) -> None:
        self.rules.insert(0, (fits, logical))

    def logical(self, kind: T.DataType) -> Logical:
        return next((name for fits, name in self.rules if fits(kind)), Logical.OTHER)


REGISTRY = TypeRegistry()


def spec_of(f: T.StructField, registry: TypeRegistry = REGISTRY) -> ColumnSpec:
    kind, meta = f.dataType, dict(f.metadata or {})
    decimal = isinstance(kind, T.DecimalType)
    return ColumnSpec(
        f.name, Logical(meta["logical"]) if "logical" in meta else registry.logical(kind), kind.simpleString(), f.nullable, meta.get("length"),
        kind.precision if decimal else meta.get("precision"), kind.scale if decimal else meta.get("scale"), meta.get("default"), meta.get("tag"),
        meta.get("writeable", True), meta.get("has_server_default", False),
    )


def schema_of(struct: T.StructType, primary_key=(), unique=(), foreign_keys=()) -> TableSchema:
    return TableSchema(tuple(map(spec_of, struct)), Constraints(tuple(primary_key), tuple(map(tuple, unique)), tuple(foreign_keys)))


def struct_of(schema: TableSchema) -> T.StructType:
    """Files that lack a column with a default are read as if they had it."""
    return T.StructType([T.StructField(c.name, T.DataType.fromDDL(c.type), True, {"EXISTS_DEFAULT": _literal(c)} if c.default is not None else None) for c in schema.columns])


def _literal(c: ColumnSpec) -> str:
    text = str(c.default).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'" if c.type == "string" else f"CAST('{text}' AS {c.type})"
