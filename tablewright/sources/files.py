"""CSV in and out, and sidecar files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a CSV reader takes for null.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, null_texts: tuple[str, ...] = NULL_TEXTS) -> DataFrame:
    """All columns as text, nulls for ``null_texts``; types are for ``operators.cast`` to find."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*null_texts), F.col(f"`{c}`")).alias(c) for c in df.columns))


def overwrite_csv(df: DataFrame, path: str) -> None:
    """Put ``df``, which may read ``path``, in its place: written beside it first, then swapped. What was there is deleted last."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, kept = f"{path.rstrip('/')}.{mark}.new", f"{path.rstrip('/')}.{mark}.old"
    df.write.csv(new, header=True, escape='"')
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for a, b in ((path, kept), (new, path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"{a} could not be renamed to {b}")
    fs.delete(at(kept), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_schema_json(spark: SparkSession, folder: str, server: str, table: str, schema: dict) -> str:
    path = f"{folder.rstrip('/')}/{server}_{table}_schema.json"
    write_text(spark, path, json.dumps(schema, indent=1, default=str))
    return path


def trace_sql(spark: SparkSession, folder: str, operation: str, table: str, text: str) -> str:
    """The SQL of an operation with its values, or a plan, for reading."""
    path = f"{folder.rstrip('/')}/{operation}_{table}.txt"
    write_text(spark, path, text)
    return path
