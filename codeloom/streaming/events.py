"""Windowed counters that run on a batch or, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_window(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` of tumbling windows; on a stream events later than ``late`` are dropped."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    """Reason-coded counters of a stream or a batch (partial and final aggregation are the engine's)."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))
