"""Streams into a collection, and streaming aggregates over an upsert log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamarack.sources.collection import Collection


def stream_upserts(stream: DataFrame, collection: Collection, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each micro-batch of (``id``, ``values``, ``metadata``, ``seq``); a batch given twice changes nothing.

    ``seq`` orders the rows of a batch; batches follow one another.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            collection.upsert_frame(kept)
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_rates(stream: DataFrame, time: str = "upserted_at", by: str = "index_name", window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(``window_start``, ``by``, ``n``): upserts in each window, late ones up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
