"""Continuous inserts: a stream of rows into a registry, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.registry import Registry


def insert_stream(registry: Registry, rows: DataFrame, checkpoint: str, order_by: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream; each micro-batch is one bulk insert.

    With identity dedup a batch that is replayed after a failure adds nothing, so inserts are exactly once.
    """

    def land(batch: DataFrame, _: int) -> None:
        registry.bulk_insert(batch, order_by)

    writer = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
