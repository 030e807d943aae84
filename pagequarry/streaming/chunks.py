"""Chunking of an unbounded stream of entries: chunking has no state, so the batch operator serves it as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagequarry.config import ChunkConfig
from pagequarry.operators.chunking import chunk_entries


def stream_chunks(entries: DataFrame, path: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Appends the chunks of a streaming DataFrame (page_id, title, content) to Parquet, each entry once."""
    return chunk_entries(entries, cfg).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
