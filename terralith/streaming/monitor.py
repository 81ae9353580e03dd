"""Residual statistics kept up to date while survey rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residual_windows(rows: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """RMS, mean and count of ``value`` by ``event_type`` and time window of ``ts``.

    Works on streams and on tables. On a stream, rows later than ``late`` are left out and a
    window is final when the watermark has passed it.
    """
    out = rows.withWatermark("ts", late) if rows.isStreaming else rows
    grouped = out.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sqrt(F.avg(F.col("value") ** 2)).alias("rms")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "rms")
