"""Documents and events as streams: repeated ones once, and upserts into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspan.sources.store import Store


def once_within(events: DataFrame, key: str, time: str = "created_at", late: str = "1 hour") -> DataFrame:
    """The first of several rows of a key that come within `late` of each other; the state of older keys is dropped. On a table: any row of each key."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upserted(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert what has come so far into the store, a snapshot a batch, and end.

    A batch that is run again after a failure replaces the same keys with the same rows, so nothing comes twice.
    """
    return stream.writeStream.foreachBatch(lambda df, _: store.upsert(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
