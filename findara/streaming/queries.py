"""Extension: events in windows of time, for streams and for tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findara.plans.catalog import query
from findara.session import table


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total``; on a stream, windows close when the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return windowed(events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
