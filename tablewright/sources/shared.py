"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where nothing does, a folder of our own, on a single machine alone."""
    where = spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set(CHECKPOINT_DIR, where)
    return where.rstrip("/")
