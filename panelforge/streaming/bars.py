"""Streams of events: hourly bars with a watermark, and merges in which the newest row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars of (event_type, hour) of a stream or table of events; rows later than the watermark are dropped by a stream.

    Times without a zone are read in the session's. First and last go by (ts, event_id), so a stream and a batch give the same bars.
    """
    order = F.struct("ts", "event_id")
    bars = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")
    )
    return bars.select("event_type", F.col("w.start").alias("h"), "open", "high", "low", "close", "n")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
