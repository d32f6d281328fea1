"""Windowed aggregates of event streams with watermarks. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a time with a zone; batch tables have none."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total) by windows of a width; events later than the watermark are left out of a stream."""
    source = _watermarked(events, time, late)
    out = source.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, n): events of a user with no longer gap between them."""
    source = _watermarked(events, time, late)
    out = source.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")
