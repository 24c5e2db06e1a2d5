"""Upkeep of a collection from a stream of chunks: last write wins, and a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vellumspark.operators.store import Collection


def upsert_stream(stream: DataFrame, collection: Collection, ts: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that upserts each micro-batch: of rows with one key the latest by `ts` holds, within a batch and against the collection. Buckets of the collection that a batch doesn't touch are left alone."""

    def batch(df: DataFrame, _: int) -> None:
        collection.merge(df, ts)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
