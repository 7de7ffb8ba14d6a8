"""Bars from a stream of ticks: the batch operator under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, every: str, late: str = "10 minutes") -> DataFrame:
    """symbol, timestamp, open, high, low, close, volume of windows that the watermark has closed.

    State is one row of partial aggregates for each open window, whatever the number of ticks.
    """
    at = F.struct("timestamp", "tie")
    timed = ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    made = timed.groupBy("symbol", F.window("timestamp", every).alias("bin")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return made.select("symbol", F.col("bin.start").alias("timestamp"), "open", "high", "low", "close", "volume")
