"""Bars from trades or ticks, and the daily panel with missing days filled forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roll_up(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """open, high, low, close and volume by key; the first and last price by a unique order of columns."""
    at = F.struct(*order)
    return ticks.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    )


def bucket(ts: Column, minutes: int, start: int = 0) -> Column:
    """Number of the bucket of `minutes` since `start` minutes after midnight."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts) - start) / minutes).cast("int")


def intraday_bars(ticks: DataFrame, minutes: int, start: int = 0) -> DataFrame:
    """Bars by symbol, session date and bucket; `bar_end` is minutes after midnight at the bucket's end."""
    timed = ticks.withColumn("date", F.to_date("ts")).withColumn("bar_end", start + minutes * (bucket(F.col("ts"), minutes, start) + 1))
    return roll_up(timed, ["symbol", "date", "bar_end"], ["ts", "tick_id"])


def fill_forward(bars: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each symbol and day; NULL before the symbol's first bar.

    A day without a bar has the close before it in all prices and no volume. `days` is a calendar, so its size is
    bounded by time and not by the bars.
    """
    grid = bars.select("symbol").distinct().crossJoin(F.broadcast(days.select("date")))
    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(bars, ["symbol", "date"], "left").withColumn("last", F.last("close", ignorenulls=True).over(past))
    volume = F.when(F.col("last").isNotNull(), F.coalesce("volume", F.lit(0.0)))
    return joined.select("symbol", "date", *(F.coalesce(c, "last").alias(c) for c in ("open", "high", "low", "close")), volume.alias("volume"))
