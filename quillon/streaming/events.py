"""Event-time aggregates, the same functions over tables and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, watermark: str | None) -> DataFrame:
    """ts as a TIMESTAMP (watermarks don't take TIMESTAMP_NTZ), with a watermark on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", watermark) if watermark and events.isStreaming else e


def tumbling(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """Counts and totals by window and type; overlapping windows where slide is given."""
    e = with_event_time(events, watermark)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = "1 hour") -> DataFrame:
    """Sessions of a user: events not further apart than gap. Spark's session windows keep state by user on streams."""
    e = with_event_time(events, watermark)
    # A session window ends just before start + gap; one more microsecond makes the gap itself inside.
    g = e.groupBy("user_id", F.session_window("ts", f"{gap} 1 microsecond").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n", "total")


def stream(spark, path: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def minibatches(df: DataFrame, handle, checkpoint: str) -> None:
    """Passes each micro-batch of what is there now to handle(batch, id) and returns: out-of-core partial fits."""
    df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
