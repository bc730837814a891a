"""The hourly rollup over a stream: late readings are taken up to the watermark, then the hour is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, device: str, period: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Works on a streaming or a batch frame; append mode emits closed hours only. ts may lack a time zone (UTC is meant)."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rolled = timed.groupBy(F.window("_ts", "1 hour"), device, period).agg(F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n"))
    return rolled.select(device, period, F.col("window.start").alias("hour"), "mean_value", "min_value", "max_value", "n")
