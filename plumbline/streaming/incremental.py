"""Incremental work: an index that follows a folder of new chunks, and counts over windows of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.tables import add_to_index, upsert


def follow(spark: SparkSession, source: str, schema, index: str, checkpoint: str, key: str = "chunk_id", version: str | None = None, replace: bool = False) -> StreamingQuery:
    """Adds the new chunks of a folder to an index, batch by batch; a repeated batch adds nothing again.

    With ``replace`` chunks that are stored already give way to newer ones (of a batch to the one with the greatest
    ``version``), in a table for upserts.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, _: int) -> None:
        if replace:
            upsert(batch.sparkSession, index, batch, key, version)
        else:
            add_to_index(batch.sparkSession, index, batch, key)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and event type; works on streams (with the watermark) and on tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, number of events and their sum."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), "n", "total")
