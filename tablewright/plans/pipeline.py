"""From a CSV file to a checked table: load, clean, cast, key, DDL, insert, upsert twice, update; with a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import quick_clean
from ..functions.identifiers import resolve, sanitize
from ..functions.types import schema_of
from ..operators import dml, predicate
from ..operators.cast import cast_df
from ..operators.profile import col, infer_key, profile
from ..sources.files import read_csv
from ..sources.store import Store
from . import ddl
from .harness import Check, Harness
from .log import log_json


@dataclass
class Result:
    operation: str
    status: str
    rows: int = 0
    message: str = ""
    duration_ms: float = 0.0


@dataclass
class Report:
    table: str
    operations: list[Result] = field(default_factory=list)
    meta: dict = field(default_factory=dict)

    def all_passed(self) -> bool:
        return bool(self.operations) and all(r.status in ("passed", "skipped") for r in self.operations)

    def passed(self) -> list[str]:
        return [r.operation for r in self.operations if r.status == "passed"]

    def to_dict(self) -> dict:
        return asdict(self) | {"all_passed": self.all_passed()}


@dataclass
class Config:
    path: str
    table: str
    key: list[str] = field(default_factory=list)
    server: str = "sqlite"
    chunk: int = 10_000
    tolerance: int = 5

    def __post_init__(self):
        if not self.path or not self.table:
            raise ValueError("path and table are needed")


class CsvJob:
    def __init__(self, spark: SparkSession, config: Config, store: Store):
        self.spark, self.config, self.store = spark, config, store
        self.frame: DataFrame | None = None
        self.sql = ""
        self.key: list[str] = []

    def run(self) -> Report:
        """Steps in order; after a failed load nothing else is tried."""
        report, began = Report(self.config.table), time.time()
        for name, step in (("load", self._load), ("key", self._find_key), ("ddl", self._create), ("insert", self._insert), ("upsert", self._upsert), ("update", self._update)):
            result = self._timed(name, step)
            report.operations.append(result)
            if name == "load" and result.status != "passed":
                break
        if self.frame is not None:
            report.meta = {"rows": report.operations[0].rows, "columns": self.frame.columns, "key": self.key, "duration_ms": 1000 * (time.time() - began)}
        log_json("pipeline", report.to_dict())
        return report

    def _timed(self, name: str, step: Callable[[], Result]) -> Result:
        began = time.time()
        try:
            result = step()
        except (ValueError, KeyError, RuntimeError) as e:
            result = Result(name, "failed", message=str(e))
        except Exception as e:  # of Spark: an unreadable file, say
            result = Result(name, "failed", message=str(e).splitlines()[0])
        result.duration_ms = 1000 * (time.time() - began)
        return result

    def _load(self) -> Result:
        self.frame = cast_df(sanitize(quick_clean(read_csv(self.spark, self.config.path)))).persist()
        return Result("load", "passed", self.frame.count())

    def _find_key(self) -> Result:
        if self.config.key:
            names = [resolve(k, self.frame.columns) for k in self.config.key]
            if None not in names:
                self.key = names
                return Result("key", "passed", message=str(names))
        found = infer_key(self.frame, profile(self.frame))
        self.key = found.components if found.unique else []
        return Result("key", "passed" if found.unique else "skipped", message=found.warning or str(self.key))

    def _create(self) -> Result:
        keys = ddl.Keys(tuple(self.key))
        self.sql = ddl.create_table_sql(self.frame.schema, ddl.facts(self.frame)[0], self.config.table, self.config.server, keys)
        self.store.create(self.config.table, schema_of(self.frame.schema, self.key), if_exists="replace")
        return Result("ddl", "passed", message=self.sql)

    def _insert(self) -> Result:
        stats = dml.insert(self.store, self.frame, self.config.table, self.config.chunk, self.config.tolerance)
        n = self.store.count(self.config.table)
        return Result("insert", "passed" if n == stats.total else "failed", n, f"{stats.failed} rejected")

    def _upsert(self) -> Result:
        if not self.key:
            return Result("upsert", "skipped", message="no key")
        counts = []
        for _ in range(2):
            dml.upsert(self.store, self.frame, self.config.table, self.key, self.config.chunk, self.config.tolerance, self.config.server)
            counts.append(self.store.count(self.config.table))
        return Result("upsert", "passed" if counts[0] == counts[1] else "failed", counts[1], f"counts {counts}")

    def _update(self) -> Result:
        """The first value that isn't null of the first row's columns outside the key changes, and is read again."""
        if not self.key:
            return Result("update", "skipped", message="no key")
        row = self.frame.orderBy(*map(col, self.key)).first()
        name = next((f.name for f in self.frame.schema if f.name not in self.key and row[f.name] is not None and isinstance(f.dataType, (T.StringType, T.NumericType)) and not isinstance(f.dataType, T.BooleanType)), None)
        if name is None:
            return Result("update", "skipped", message="nothing to change")
        new = f"{row[name]}_updated" if isinstance(row[name], str) else row[name] + 1
        where = [(k, "=", row[k]) for k in self.key]
        n = dml.update(self.store, self.config.table, {name: new}, where)
        read = predicate.where(self.store.read(self.config.table), where).select(F.col(f"`{name}`")).first()
        return Result("update", "passed" if n >= 1 and read[0] == new else "failed", n, f"{name} = {new!r}")


class CrudCycle:
    """The harness on a given frame, and SQL text of a condition if one is given."""

    def __init__(self, store: Store):
        self.store = store

    def run(self, df: DataFrame, key: list[str], constraint: list[str], table: str, dialect: str = "sqlite", where=None, expression: str | None = None) -> tuple[list[Check], predicate.Where | None]:
        checks = Harness(df, key, constraint, table).run(self.store, dialect)
        if where is None:
            return checks, None
        return checks, predicate.where_sql(predicate.bind(where, df.columns, allow_missing=True), expression, dialect)
