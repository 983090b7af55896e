"""Streaming forms: windows and first-seen rows over a stream of captures (beyond what the batch queries need)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Counts and sums by hour and type. With a watermark, late rows beyond it are dropped and finished hours come out once."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    g = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def first_seen(captures: DataFrame, *keys: str, watermark: str = "6 hours") -> DataFrame:
    """Each key once within the watermark, as the response cache does for definitive answers."""
    return captures.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
