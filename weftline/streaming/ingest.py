"""Incremental ingest: new texts are chunked as they arrive; late and repeated rows are dropped by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.chunking import fixed_chunks


def once_per_key(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than ``delay`` is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def chunk_stream(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id", text: str = "text", **trigger) -> StreamingQuery:
    """Writes fixed chunks of every micro-batch below ``target``; a batch that is repeated overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        fixed_chunks(batch, key, text).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, kind, n) over event time, final once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
