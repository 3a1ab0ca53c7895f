"""What the operators share: reading, shared scratch tables, and Arrow batch maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether the shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within delete their shuffle files at their end. For those whose result is kept elsewhere and that don't run again."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


class Scratch:
    """Intermediate tables of one run, written to the shared folder so that lost executors cost no recomputation. Results are lazy and
    read them, so they go when the application ends, or by ``drop`` and ``clear`` before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written; lineage ends there."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in dfs:
            fs, path = self._at(df._scratch_path)
            fs.delete(path, True)

    def clear(self) -> None:
        """Delete all tables of the run."""
        fs, path = self._at(self.root)
        fs.delete(path, True)


#: A key that has more than one in HOT_KEYS of all rows, and over HOT_ROWS, is hot. As shares sum up to 1, there are fewer than HOT_KEYS hot ones, whatever the rows.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``rows`` joined with ``counted``, which has a row for each key and in ``count`` how many of ``rows`` have it. Hot keys are
    broadcast, at most HOT_KEYS of them, so their rows stay where they are; no other key has a share of note. Both are read
    more than once, so they should be tables."""
    total, most = counted.agg(F.sum(count), F.max(count)).first()
    line = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if not total or most <= line:
        return rows.join(counted, keys)
    is_hot = F.col(count) > line
    hot, cold = counted.where(is_hot), counted.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


#: Most bytes of an Arrow batch between Spark and Python. It bounds what a task holds on either side, whatever the texts' lengths.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def map_in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in small batches. Bounds the session's batch size where it is larger, and gives memory back after each task."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: Bytes of Arrow data that are turned into Python objects at a time.
PART_BYTES = 4 << 20


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about PART_BYTES, at least a row each, so that Python holds little beside the batch itself."""
    for b in batches:
        step = max(1, b.num_rows * PART_BYTES // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn`` maps a dict of column lists to a dict of column lists, part by part."""
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            yield pa.RecordBatch.from_pydict(fn(b.to_pydict()), schema=out)

    return map_in_arrow(df, run, schema)


def pa_schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Stands for a null id in keys; it comes first.
NO_ID = -(1 << 63)


def key_columns() -> list[Column]:
    """The key of a row of documents: d, its id (NO_ID for null), and t, a hash of its text."""
    text = F.col("text").cast("string")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t")]


def keyed(docs: DataFrame) -> DataFrame:
    """(row, d, t): all columns of a row as one, so that no name of theirs can clash, and its key."""
    return docs.select(F.struct("*").alias("row"), *key_columns())


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (d, t); the texts stream past the keys."""
    return keyed(docs).join(dropped.select("d", "t").hint("shuffle_hash"), ["d", "t"], "left_anti").select("row.*")


def filter_batches(docs: DataFrame, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of ``docs``, all columns as they are, of which ``keep`` says True by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            yield b.filter(pa.array(keep(b.column("text").to_pylist()), pa.bool_()))

    return map_in_arrow(docs, run, docs.schema)
