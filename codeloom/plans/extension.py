"""Beyond the reference: event-time windows, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.registry import query
from codeloom.sources.tables import table
from codeloom.streaming.events import by_window


@query("""
select time_bucket(interval '1 hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of hourly windows; the same function runs on a stream."""
    return by_window(table(spark, d, "events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))
