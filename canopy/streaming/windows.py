"""Windows over event streams: extensions, with batch results that match those of the operators.

Both functions take batch frames as well; on a stream the watermark bounds the state, and rows later
than it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, first, last, events) of bursts of events that are less than gap apart."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events")).select(key, "first", "last", "events")


def counts(events: DataFrame, key: str, time: str, width: str = "14 days", late: str = "1 day") -> DataFrame:
    """(key, start, events) of tumbling windows, aligned to the epoch."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")
