"""Bars from a stream of ticks: late rows up to the watermark are counted, repeated ones are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """OHLCV by symbol and window of event time, emitted when the watermark has passed the window."""
    seen = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "tick_id"])
    at = F.struct("ts", "tick_id")
    bars = seen.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume")
