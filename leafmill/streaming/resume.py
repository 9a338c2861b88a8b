"""Streaming extensions: exactly-once resume of chunk processing, and windowed counts of late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume_chunks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int = 64) -> None:
    """Processes what has arrived since the last call and nothing twice: the file sink and the
    checkpoint take the place of the search for existing output files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by window and type; the watermark bounds the state."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("__t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
