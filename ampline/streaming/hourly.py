"""Structured Streaming form of the site-hour trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_trend(stream: DataFrame, site: str, time: str, value: str, late: str = "1 hour") -> DataFrame:
    """Totals and counts of each site and hour, with a watermark for late rows. Works on batches too."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", "1 hour").alias("w"), F.col(site).alias("site")).agg(F.sum(value).alias("total"), F.count("*").alias("records"))
    return out.select("site", F.col("w.start").alias("ts"), "total", "records")
