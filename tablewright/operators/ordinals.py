"""Dense row numbers without a one-task window: rows are sorted by ranges, numbered within a partition, and shifted by the
counts of the partitions before. What was numbered is checkpointed, so a lost executor can't renumber it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

ORDINAL = "__ord"


def with_checkpoint_dir(df: DataFrame) -> DataFrame:
    """Make sure that checkpoints have a folder, which all executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df


def with_ordinal(df: DataFrame, order_by: list[str] | None = None, name: str = ORDINAL) -> DataFrame:
    """``df`` with its rows numbered from 1, in order of ``order_by``, then of all other columns, so that only equal rows tie."""
    if name in df.columns:
        return df
    first = list(order_by or [])
    names = first + [f.name for f in df.schema if f.name not in first and f.dataType.typeName() not in ("map", "variant")]
    keys = [F.col(f"`{c}`") for c in names]
    placed = df.orderBy(*keys).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = with_checkpoint_dir(placed).checkpoint()
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(before, "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")
