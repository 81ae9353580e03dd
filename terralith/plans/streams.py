"""Queries on the residual monitor."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.plans import bindings as b
from terralith.plans.registry import query
from terralith.streaming.monitor import residual_windows


@query("residual_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(avg(value*value)), 6) AS rms FROM events GROUP BY 1, 2")
def residual_monitor(spark, d):
    e = b.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = residual_windows(e)
    return out.select(F.unix_micros(F.col("start")).alias("start_us"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"))
