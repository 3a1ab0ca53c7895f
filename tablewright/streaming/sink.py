"""Apply each micro-batch of a stream to a snapshot table. A batch that is tried again gives the same table, as upserts repeat safely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import dml
from ..sources.store import Store


def upsert_stream(stream: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str, order_by: list[str] | None = None, **options) -> StreamingQuery:
    """``options`` go to dml.upsert. Reads what is there and ends."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            dml.upsert(store, batch, table, keys, order_by=order_by, **options)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
