"""The transform chain on a stream. Every step but exact-row deduplication is stateless; that one runs per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import etl


def stream_load(stream: DataFrame, table: str, kinds: dict[str, str], required: list[str], checkpoint: str, mode: str = "append", key: str | None = None, buckets: int = 0) -> StreamingQuery:
    """Micro-batches go through `transform`; valid rows are loaded. With mode="upsert" a batch that is run again
    after a failure changes nothing. Batches load in the stream's own session: another that has read the table already
    calls `catalog.refreshTable` to see them."""

    def batch(df: DataFrame, _: int) -> None:
        etl.load(etl.transform(df, kinds, required).where("is_valid"), table, mode, key, buckets)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
