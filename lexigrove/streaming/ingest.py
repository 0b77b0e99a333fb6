"""Incremental indexing of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lexigrove.engine import SearchIndex


def index_stream(documents: DataFrame, index: SearchIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each micro-batch to the index, which skips documents that are as they were, so a batch that is sent again changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.add(batch)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
