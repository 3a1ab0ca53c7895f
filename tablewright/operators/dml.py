"""Insert, upsert and update on the tables of a store.

A statement first writes its source as files of the table. Where all rows are good, which a few aggregates tell, an insert adds
these very files, and so does an upsert that finds none of its keys. An upsert that finds some, by a scan of the key columns,
merges the files that hold them, and no others; an update likewise. The dialects of the five databases differ in how they write a
merge, not in what it does, so there is one implementation; ``dialect`` selects the few differences in meaning.

Where a row is bad, or keys of an upsert repeat, order matters, and rows are numbered. They are then isolated as a row-by-row fallback
would: rows that break a rule are rejected with their reasons, and after ``tolerance`` rejections within a chunk of the source's
order the rest of that chunk isn't tried. One window over each chunk gives that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import resolve
from ..functions.types import ColumnSpec, TableSchema
from ..sources.store import FILE, Snapshot, Store
from . import correct, predicate, validate
from .mapping import ignoring_case, rename
from .ordinals import ORDINAL, with_checkpoint_dir, with_ordinal
from .profile import absent, col

CHUNK, TOLERANCE = 10_000, 5
DIALECTS = ("oracle", "sqlite", "mssql", "mysql", "mariadb", "postgres", "postgresql")


@dataclass
class ChunkStats:
    chunk: int
    total: int
    success: int
    failed: int
    unprocessed: int

    @property
    def method(self) -> str:
        return "row" if self.failed else "bulk"

    @property
    def aborted(self) -> bool:
        return self.unprocessed > 0


@dataclass
class Stats:
    """``by_chunk``: a row for each chunk that had failures (chunk, written, failed, unprocessed); None if none had."""

    total: int = 0
    success: int = 0
    failed: int = 0
    method: str = "bulk"
    by_chunk: DataFrame | None = None

    def each_chunk(self) -> Iterator[ChunkStats]:
        """One by one, in order; a partition of them is on the driver at a time."""
        for r in self.by_chunk.orderBy("chunk").toLocalIterator() if self.by_chunk is not None else ():
            yield ChunkStats(int(r["chunk"]), r["written"] + r["failed"] + r["unprocessed"], r["written"], r["failed"], r["unprocessed"])

    @property
    def chunks(self) -> list[ChunkStats]:
        return list(self.each_chunk())


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def in_table_case(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Columns named as in the table; unknown ones are an error."""
    if unknown := [c for c in df.columns if c != ORDINAL and resolve(c, schema.names) is None]:
        raise ValueError(f"columns not in the table: {unknown}")
    return rename(df, ignoring_case(df.columns, schema.names))


# Frames


def last_of_each(source: DataFrame, keys: list[str], order: str = ORDINAL) -> DataFrame:
    """The last row of each whole key, as applying the rows one by one would leave it; rows with a null key all stay."""
    whole = ~_null_key(source, keys)
    last = F.row_number().over(W.partitionBy(*(col(k) for k in keys)).orderBy(F.desc(order)))
    found = source.where(whole).withColumn("__nth", last).where("__nth = 1").drop("__nth")
    return found.unionByName(source.where(~whole))


def _null_key(df: DataFrame, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | absent(df, k)
    return out


def upserted(target: DataFrame, source: DataFrame, keys: list[str], order: str = ORDINAL, match: list[str] | None = None, once: bool = False) -> DataFrame:
    """``target`` after an upsert. Columns that the source lacks keep their value, and are null in new rows. A null key matches
    nothing. ``match``: columns of the source that say which keys its rows change, where these aren't ``keys`` themselves. ``once``: no key repeats."""
    match = match or keys
    own = [c for c in source.columns if c in target.columns]
    rows = source if once else last_of_each(source, match, order)
    s = rows.select(*(col(c).alias(f"__s_{c}") for c in own), *(col(m).alias(f"__m_{k}") for k, m in zip(keys, match, strict=True)), F.lit(True).alias("__hit"))
    on = F.lit(True)
    for k in keys:
        on = on & (target[f"`{k}`"] == s[f"`__m_{k}`"])
    joined = target.join(s, on, "full_outer")
    return joined.select(*(F.when(F.col("__hit"), col(f"__s_{c}")).otherwise(col(c)).alias(c) if c in own else col(c) for c in target.columns))


def updated(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``target`` with ``values`` where ``where`` holds; null counts as not."""
    holds = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(holds, values[c]).otherwise(col(c)).alias(c) if c in values else col(c) for c in target.columns))


def reasons(source: DataFrame, schema: TableSchema, target: DataFrame | None, order: str | None = ORDINAL, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """``source`` with ``__reasons``: why each row can't be written. Whole foreign keys are looked up in ``parents``, by table. Keys are
    compared for inserts, where ``target`` is given; of rows with equal keys that are good otherwise, the first is good. Without ``order``
    equal keys within the source are not compared."""
    found = []
    for c in schema.columns:
        if c.name not in source.columns:
            continue
        if not c.nullable and c.tag != "identity":
            found.append(F.when(absent(source, c.name), F.lit(f"null in {c.name}")))
        if c.length is not None:
            found.append(F.when(F.length(col(c.name).cast("string")) > c.length, F.lit(f"{c.name} is too long")))
    df = source.withColumn("__reasons", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))
    for fk in schema.constraints.foreign_keys:
        if fk.table in (parents or {}) and all(k in df.columns for k in fk.columns):
            why = F.when(~F.coalesce(F.col("__there"), F.lit(False)) & ~_null_key(df, list(fk.columns)), F.lit(f"key ({', '.join(fk.columns)}) is not in {fk.table}"))
            df = _looked_up(df, parents[fk.table], fk.columns, fk.references, why)
    if target is None:
        return df
    for key in schema.key_sets():
        if not all(k in df.columns for k in key):
            continue
        label = ", ".join(key)
        df = _looked_up(df, target, key, key, F.when(F.col("__there"), F.lit(f"key ({label}) exists")))
        if order is not None:
            nth = F.row_number().over(_good_by(df, key, order).orderBy(order))
            good = (F.size("__reasons") == 0) & ~_null_key(df, list(key))
            df = df.withColumn("__nth", nth)
            df = df.withColumn("__reasons", F.when(good & (F.col("__nth") > 1), F.array_append("__reasons", F.lit(f"key ({label}) repeats"))).otherwise(F.col("__reasons"))).drop("__nth")
    return df


def _good_by(df: DataFrame, key, order: str):
    """A window for each whole key over its good rows. Others are alone, each by its number, so they meet in no task."""
    good = (F.size("__reasons") == 0) & ~_null_key(df, list(key))
    return W.partitionBy(*(F.when(good, col(k)) for k in key), F.when(good, F.lit(0)).otherwise(F.col(order)))


def _looked_up(df: DataFrame, other: DataFrame, mine, theirs, why: Column) -> DataFrame:
    """``df`` with ``why``, if it isn't null, among its reasons; ``__there`` says in it whether ``other`` has the row's key. Of ``other``
    only keys that ``df`` has are compared and shuffled."""
    own = validate.whole_keys(df, mine).toDF(*(f"__t_{k}" for k in theirs))
    known = other.select(*(col(k).alias(f"__t_{k}") for k in theirs)).join(own, list(own.columns), "left_semi").distinct().withColumn("__there", F.lit(True))
    on = F.lit(True)
    for a, b in zip(mine, theirs, strict=True):
        on = on & (df[f"`{a}`"] == known[f"`__t_{b}`"])
    joined = df.join(known, on, "left").drop(*(f"__t_{k}" for k in theirs))
    return joined.withColumn("__reasons", F.array_compact(F.array_append("__reasons", why))).drop("__there")


# Unique sets beside the key of an upsert


def _differ(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = out | ~x.eqNullSafe(y)
    return out


def _others(schema: TableSchema, key, columns) -> list[tuple[str, ...]]:
    return [u for u in schema.key_sets() if set(u) != set(key) and all(c in columns for c in u)]


def _owners(df: DataFrame, target: DataFrame, key, unique) -> DataFrame:
    """Rows of ``df`` with the key ``__o_*`` of a row of ``target`` that has the same whole ``unique`` and another key."""
    own = validate.whole_keys(df, unique).toDF(*(f"__u_{c}" for c in unique))
    held = target.select(*(col(c).alias(f"__u_{c}") for c in unique), *(col(k).alias(f"__o_{k}") for k in key)).join(own, list(own.columns), "left_semi")
    on = _differ([df[f"`{k}`"] for k in key], [held[f"`__o_{k}`"] for k in key])
    for c in unique:
        on = on & (df[f"`{c}`"] == held[f"`__u_{c}`"])
    return df.join(held, on)


def may_clash(source: DataFrame, target: DataFrame, schema: TableSchema, key) -> bool:
    """Whether a row may break another unique set than its key: a row of another key has the same values, in the table or the source."""
    for unique in _others(schema, key, source.columns):
        whole = source.where(~_null_key(source, list(unique)))
        several = whole.groupBy(*(col(c) for c in unique)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not several.isEmpty() or not _owners(source, target, key, unique).isEmpty():
            return True
    return False


def clashes(df: DataFrame, target: DataFrame, schema: TableSchema, key, order: str = ORDINAL) -> DataFrame:
    """Adds to ``__reasons`` what rows of an upsert break in other unique sets than ``key``, as applying them one by one would tell: a row of
    the table with the same values and another key, unless an earlier row gives it other values; or an earlier good row of another key."""
    for unique in _others(schema, key, df.columns):
        label = ", ".join(unique)
        held = _owners(df.where(F.size("__reasons") == 0), target, key, unique)
        s = df.select(*(col(k).alias(f"__k_{k}") for k in key), *(col(c).alias(f"__v_{c}") for c in unique), F.col(order).alias("__when"))
        freed = (F.col("__when") < F.col(order)) & _differ([F.col(f"`__v_{c}`") for c in unique], [F.col(f"`__u_{c}`") for c in unique])
        for k in key:
            freed = freed & (F.col(f"`__k_{k}`") == F.col(f"`__o_{k}`"))
        bad = held.join(s, freed, "left_anti").select(F.col(order).alias("__bad")).distinct()
        why = F.when(F.col("__bad").isNotNull(), F.lit(f"({label}) is another row's"))
        df = df.join(bad, df[order] == bad["__bad"], "left").withColumn("__reasons", F.array_compact(F.array_append("__reasons", why))).drop("__bad")
        first = F.first(F.struct(*(col(k) for k in key))).over(_good_by(df, unique, order).orderBy(order))
        df = df.withColumn("__first", first)
        good = (F.size("__reasons") == 0) & ~_null_key(df, list(unique))
        other = F.lit(False)
        for k in key:
            other = other | ~F.col("__first").getField(k).eqNullSafe(col(k)) | col(k).isNull() & (F.col("__nth") > 1)
        df = df.withColumn("__nth", F.row_number().over(_good_by(df, unique, order).orderBy(order)))
        df = df.withColumn("__reasons", F.when(good & other, F.array_append("__reasons", F.lit(f"({label}) is another row's"))).otherwise(F.col("__reasons"))).drop("__first", "__nth")
    return df


def matched_by_any(source: DataFrame, target: DataFrame, schema: TableSchema, key) -> DataFrame:
    """``source`` with ``__m_{k}``: the key of the row that it changes where any unique set may match, the sets in order; its own key if none does."""
    df = source
    sets = [key, *_others(schema, key, source.columns)]
    for i, unique in enumerate(sets):
        own = validate.whole_keys(source, unique).toDF(*(f"__u_{c}" for c in unique))
        held = target.select(*(col(c).alias(f"__u_{c}") for c in unique), F.struct(*(col(k) for k in key)).alias(f"__f{i}")).join(own, list(own.columns), "left_semi").dropDuplicates(list(own.columns))
        on = F.lit(True)
        for c in unique:
            on = on & (df[f"`{c}`"] == held[f"`__u_{c}`"])
        df = df.join(held, on, "left").drop(*own.columns)
    found = F.coalesce(*(F.col(f"__f{i}") for i in range(len(sets))), F.struct(*(col(k) for k in key)))
    return df.withColumns({f"__m_{k}": found.getField(k) for k in key}).drop(*(f"__f{i}" for i in range(len(sets))))


def isolated(checked: DataFrame, chunk: int = CHUNK, tolerance: int = TOLERANCE, order: str = ORDINAL) -> DataFrame:
    """Adds ``__chunk`` and ``__status``: written, failed or unprocessed. No window holds more than a chunk."""
    bad = (F.size("__reasons") > 0).cast("int")
    df = checked.withColumn("__chunk", F.floor((F.col(order) - 1) / chunk))
    prior = F.coalesce(F.sum(bad).over(W.partitionBy("__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    status = F.when(prior >= tolerance, "unprocessed").when(bad == 1, "failed").otherwise("written")
    return df.withColumn("__status", status)


def stats_of(rows: DataFrame) -> Stats:
    """Totals, and the chunks that had failures. A chunk that failed without writing a row is an error, as nothing of it was right."""
    count = lambda s: F.count_if(F.col("__status") == s).alias(s)
    each = rows.groupBy(F.col("__chunk").alias("chunk")).agg(count("written"), count("failed"), count("unprocessed"))
    void = F.count_if((F.col("failed") > 0) & (F.col("written") == 0))
    written, failed, unprocessed, nothing = each.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("written", "failed", "unprocessed")), void).first()
    out = Stats(written + failed + unprocessed, written, failed, "row" if failed else "bulk", each.where("failed > 0") if failed else None)
    if nothing:
        raise RuntimeError(f"no row of {nothing} chunks could be written: {out}")
    return out


# Statements


@dataclass
class _Source:
    """A statement's rows, written as files that the table doesn't have yet, and the version that it reads."""

    store: Store
    at: Snapshot
    files: tuple[str, ...]
    rows: DataFrame

    @property
    def schema(self) -> TableSchema:
        return self.at.schema

    def parents(self) -> dict[str, DataFrame]:
        return {fk.table: self.store.read(fk.table) for fk in self.schema.constraints.foreign_keys if self.store.exists(fk.table)}

    def numbered(self, order_by: list[str] | None) -> DataFrame:
        return with_ordinal(self.rows, order_by)

    def isolate(self, checked: DataFrame, chunk: int, tolerance: int) -> tuple[Stats, DataFrame]:
        """What became of numbered rows, and those that are good."""
        rows = with_checkpoint_dir(checked).checkpoint()
        rows = isolated(rows, chunk, tolerance)
        try:
            stats = stats_of(rows)
        except RuntimeError:
            self.store.unstage(self.at, self.files)
            raise
        return stats, rows.where("__status = 'written'").drop("__chunk", "__status", "__reasons")

    def write(self, rows: DataFrame, remove=(), after_others: bool = False) -> None:
        """Commit rows of the table in place of the staged files."""
        schema = self.schema
        self.store.publish(self.at, self.store.stage(self.at.path, self.store.fitted(rows, schema)), remove, after_others=after_others)
        self.store.unstage(self.at, self.files)


def _staged(store: Store, data, table: str) -> _Source:
    """Columns in the table's names and types; one that the data lacks is left out, so files that have none of it are read as its default."""
    from .cast import to_frame

    at = store.snapshot(table)
    df = nan_to_null(in_table_case(to_frame(store.spark, data), at.schema))
    df = df.select(*(col(c).cast(at.schema[c].type).alias(c) if c != ORDINAL else F.col(ORDINAL).cast("long").alias(c) for c in df.columns))
    files = store.stage(at.path, df)
    return _Source(store, at, files, store.files(at, files, df.schema))


def _identity(schema: TableSchema) -> ColumnSpec | None:
    return next((c for c in schema.columns if c.tag == "identity"), None)


def _with_ids(source: _Source, rows: DataFrame, order_by: list[str] | None) -> DataFrame:
    """Rows whose column that counts up is null get the numbers after the table's highest, in order."""
    c = _identity(source.schema)
    if c is None:
        return rows
    own = rows if c.name in rows.columns else rows.withColumn(c.name, F.lit(None).cast(c.type))
    high = F.max(F.col(f"`{c.name}`"))
    highest = [x for x in (source.store.rows(source.at).agg(high).first()[0], own.agg(high).first()[0]) if x is not None]
    base = max([c.start - 1, *highest])
    free = with_ordinal(own.where(absent(own, c.name)).drop(ORDINAL), order_by, "__nth")
    free = free.withColumn(c.name, (F.col("__nth") + F.lit(base)).cast(c.type)).drop("__nth")
    return own.where(~absent(own, c.name)).drop(ORDINAL).unionByName(free)


def insert(store: Store, data, table: str, chunk: int = CHUNK, tolerance: int = TOLERANCE, order_by: list[str] | None = None) -> Stats:
    source = _staged(store, data, table)
    schema, target, parents = source.schema, store.rows(source.at), source.parents()
    checked = reasons(source.rows, schema, target, None, parents)
    total, bad = checked.agg(F.count(F.lit(1)), F.count_if(F.size("__reasons") > 0)).first()
    keys = [k for k in schema.key_sets() if all(c in source.rows.columns for c in k)]
    repeat = any(validate.has_duplicates(source.rows.where(~_null_key(source.rows, list(k))), k) for k in keys)
    if bad or repeat:
        stats, good = source.isolate(reasons(source.numbered(order_by), schema, target, parents=parents), chunk, tolerance)
        source.write(_with_ids(source, good, order_by))  # compared with this version's keys, so others may not come between
    else:
        stats = Stats(total, total)
        if _identity(schema):
            source.write(_with_ids(source, source.rows, order_by))
        else:
            store.publish(source.at, source.files, after_others=not keys)
    return stats


def upsert(store: Store, data, table: str, keys: list[str], chunk: int = CHUNK, tolerance: int = TOLERANCE, dialect: str = "sqlite", order_by: list[str] | None = None) -> Stats:
    """``keys`` must be the primary key or a unique set; other unique sets must hold as well. For mysql any unique set of the table may match,
    whatever ``keys`` say, and the row that matches takes all columns; where several rows change one, the last does."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect!r}")
    schema = store.schema(table)
    any_key = dialect in ("mysql", "mariadb") and bool(schema.key_sets())
    key = list(schema.key_sets()[0] if any_key else validate.conflict_key(keys, schema))
    source = _staged(store, data, table)
    if missing := [k for k in key if k not in source.rows.columns]:
        store.unstage(source.at, source.files)
        raise ValueError(f"key columns are missing: {missing}")
    target, parents = store.rows(source.at), source.parents()
    checked = reasons(source.rows, schema, None, None, parents)
    total, bad = checked.agg(F.count(F.lit(1)), F.count_if(F.size("__reasons") > 0)).first()
    repeat = validate.has_duplicates(source.rows.where(~_null_key(source.rows, key)), key)
    match = [f"__m_{k}" for k in key] if any_key else key
    ordered = bool(bad or repeat or (any_key and len(schema.key_sets()) > 1) or may_clash(source.rows, target, schema, key))
    if ordered:
        rows = reasons(source.numbered(order_by), schema, None, parents=parents)
        if not any_key:
            rows = clashes(rows, target, schema, key)
        stats, good = source.isolate(rows, chunk, tolerance)
        if any_key:
            good = matched_by_any(good, target, schema, key)
        good = last_of_each(good, match)
    else:
        stats, good = Stats(total, total), source.rows.withColumns({m: col(k) for k, m in zip(key, match, strict=True) if m != k})
    wanted = good.select(*(col(m).alias(k) for k, m in zip(key, match, strict=True))).distinct()
    held = store.rows(source.at, named=True).select(*key, FILE).join(wanted, key, "left_semi").select(FILE).distinct()
    touched = sorted(r[FILE] for r in held.collect())  # names of files that have rows to change
    if touched or ordered or _identity(schema):
        merged = upserted(store.rows(source.at, touched), good, key, match=match, once=True)
        source.write(_with_ids(source, merged, order_by), touched)
    else:
        store.publish(source.at, source.files)
    return stats


def lazy_upsert(store: Store, data, table: str, keys: list[str], dialect: str = "sqlite") -> Stats:
    """An upsert that tries every row, whatever fails; there is no tolerance to run out of."""
    out = upsert(store, data, table, keys, tolerance=1 << 62, dialect=dialect)
    out.method = "lazy_only"
    return out


def update(store: Store, table: str, data, where, expression: str | None = None, columns: list[str] | None = None) -> int:
    """Set the columns of the one row (or first row) ``data`` where the conditions hold. Returns the rows that matched; files without any stay."""
    at = store.snapshot(table)
    schema = at.schema
    rows = data if isinstance(data, list) else [predicate.only_row(data)]
    row = {resolve(k.lstrip("\ufeff"), schema.names) or k: v for k, v in rows[0].items()}
    if unknown := [k for k in row if k not in schema.names]:
        raise ValueError(f"columns not in the table: {unknown}")
    holds = predicate.predicate(where, expression, schema.names, row)
    held = {r[FILE]: r["count"] for r in store.rows(at, named=True).where(holds).groupBy(FILE).count().collect()}  # a row for each file that matches
    if held:
        names = columns or list(row)
        values = {resolve(c, schema.names): F.lit(row[resolve(c, schema.names)]).cast(schema[c].type) for c in names}
        store.publish(at, store.stage(at.path, updated(store.rows(at, sorted(held)), holds, values)), held)
    return sum(held.values())


def _aligned(store: Store, data, table: str, add_missing: bool, failure_threshold: float) -> DataFrame:
    """Corrected for the table: failing values become null; new columns are added to the table first, if asked for."""
    from .cast import to_frame

    df, policy = to_frame(store.spark, data), correct.Policy(correct.C.OnError.COERCE, correct.threshold_of(failure_threshold))
    out, report = correct.correct(df, store.schema(table), policy, evolve=add_missing)
    if report.added:
        names = {s: t for s, t in report.mapping.pairs.items() if t in report.added}
        store.add_columns(table, [correct.added_spec(df, s) for s in names])
    return out


def auto_insert(store: Store, data, table: str, add_missing: bool = True, failure_threshold: float = 3, **options) -> Stats:
    return insert(store, _aligned(store, data, table, add_missing, failure_threshold), table, **options)


def auto_upsert(store: Store, data, table: str, keys: list[str], add_missing: bool = True, failure_threshold: float = 3, **options) -> Stats:
    return upsert(store, _aligned(store, data, table, add_missing, failure_threshold), table, keys, **options)


def auto_update(store: Store, table: str, data, where, expression: str | None = None, **options) -> int:
    return update(store, table, data if isinstance(data, (dict, list)) else [data.first().asDict()], where, expression, **options)


# SQL text


def merge_sql(table: str, columns: list[str], keys: list[str], dialect: str) -> str:
    """The upsert statement that a database of this dialect takes, with a parameter for each column."""
    values = [c for c in columns if c not in keys]
    names, params = ", ".join(columns), ", ".join(f":{c}" for c in columns)
    if dialect in ("sqlite", "postgres", "postgresql"):
        act = "DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in values) if values else "DO NOTHING"
        return f"INSERT INTO {table} ({names}) VALUES ({params}) ON CONFLICT ({', '.join(keys)}) {act}"
    if dialect in ("mysql", "mariadb"):
        return f"INSERT INTO {table} ({names}) VALUES ({params}) ON DUPLICATE KEY UPDATE " + ", ".join(f"{c} = VALUES({c})" for c in columns)
    if dialect not in ("oracle", "mssql"):
        raise ValueError(f"unknown dialect: {dialect!r}")
    source = "SELECT " + ", ".join(f":{c} AS {c}" for c in columns) + (" FROM dual" if dialect == "oracle" else "")
    text = f"MERGE INTO {table} t USING ({source}) s ON ({' AND '.join(f't.{k} = s.{k}' for k in keys)})"
    if values:
        text += " WHEN MATCHED THEN UPDATE SET " + ", ".join(f"t.{c} = s.{c}" for c in values)
    text += f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{c}' for c in columns)})"
    return text + (";" if dialect == "mssql" else "")
