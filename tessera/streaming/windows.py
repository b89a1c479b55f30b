"""Event-time windows over an event table, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 day", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, total) of windows that don't overlap."""
    return events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of runs of a key's events with less than gap between them."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_tumbling(events: DataFrame, checkpoint: str, table: str, width: str = "1 day", late: str = "1 day"):
    """Runs what has arrived so far to the end, into the memory table; windows close once the watermark passes them."""
    counts = tumbling_counts(events.withWatermark("ts", late), width)
    return counts.writeStream.outputMode("append").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
