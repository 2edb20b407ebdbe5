"""Live samples: the batch operators' nearest kin over unbounded input, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Statistics of (session_id, channel, ts, v) per time window; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "session_id", "channel")
    return g.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")).select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "session_id", "channel", "n", "min", "max", "mean")


def live_runs(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs as session windows: stretches of a session without a pause of `gap`."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
    return g.agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("session_id", F.col("w.start").alias("start_ts"), "last_ts", "n")


def once_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Repeated deliveries of a row out, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
