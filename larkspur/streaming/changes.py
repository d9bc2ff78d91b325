"""A stream of records as upserts: an extension over Structured Streaming.

Each micro-batch is one commit.  A batch that is delivered again after a
failure replaces the same ids, so the collection ends up the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.session import Scope


def upsert_stream(rows: DataFrame, scope: Scope, drawer: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a streaming DataFrame (_id, doc VARIANT) into a stored collection."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            scope.upsert_frame(batch, drawer)

    writer = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
