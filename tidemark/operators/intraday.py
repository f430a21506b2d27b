"""Point-in-time intraday features: VWAP, relative volume, opening range, Wilder's ATR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK, LEAST_HISTORY, PERIOD = 20, 10, 14


def session_features(bars: DataFrame, minutes: int, ranges: list[int]) -> DataFrame:
    """VWAP and the one before, cumulative volume, minutes since the open, opening ranges. Three passes, one exchange."""
    whole = Window.partitionBy("symbol", "date")
    session = whole.orderBy("bar_end")
    so_far = session.rowsBetween(Window.unboundedPreceding, 0)
    turnover = F.sum((F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume")).over(so_far)
    volume = F.sum("volume").over(so_far)
    out = bars.withColumn("cum_volume", volume).withColumn("vwap", F.when(F.col("cum_volume") > 0, turnover / F.nullif("cum_volume", F.lit(0.0))))
    out = out.withColumn("prev_vwap", F.lag("vwap").over(session)).withColumn("minutes", (F.col("bar_end") - F.min("bar_end").over(whole) + minutes).cast("int"))
    for w in ranges:
        inside = F.col("minutes") <= w
        out = out.withColumn(f"or_high_{w}", F.max(F.when(inside, F.col("high"))).over(whole)).withColumn(f"or_low_{w}", F.min(F.when(inside, F.col("low"))).over(whole))
    return out.withColumn("idx", F.row_number().over(session) - 1)


def relative_volume(features: DataFrame) -> DataFrame:
    """Cumulative volume over the median of earlier sessions at the same minute."""
    earlier = Window.partitionBy("symbol", "minutes").orderBy("date").rowsBetween(-LOOKBACK, -1)
    median = F.when(F.count("cum_volume").over(earlier) >= LEAST_HISTORY, F.percentile("cum_volume", F.lit(0.5)).over(earlier))
    out = features.withColumn("_m", median)
    return out.withColumn("rvol", F.when(F.col("_m") > 0, F.col("cum_volume") / F.nullif("_m", F.lit(0.0)))).drop("_m")


def true_range(bars: DataFrame) -> DataFrame:
    """(symbol, date, tr) of sessions with a range; the previous close is that of the last such session."""
    day = bars.groupBy("symbol", "date").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_end").alias("close")).where("high > low")
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_c")), F.abs(F.col("low") - F.col("_c")))
    return day.withColumn("_c", before).select("symbol", "date", tr.alias("tr"))


def wilder_atr(ranges: DataFrame, period: int = PERIOD) -> DataFrame:
    """(symbol, date, atr) after each session with a range; a symbol's sessions are one fold."""
    days = ranges.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "tr"))).alias("d"))
    seed = f"aggregate(slice(d, 1, {period}), 0.0D, (a, x) -> a + x.tr) / {period}"
    fold = f"""aggregate(slice(d, {period + 1}, greatest(size(d) - {period}, 0)), array(named_struct('date', d[{period - 1}].date, 'atr', {seed})),
        (a, x) -> concat(a, array(named_struct('date', x.date, 'atr', (element_at(a, -1).atr * {period - 1} + x.tr) / {period}))))"""
    return days.where(F.size("d") >= period).select("symbol", F.explode(F.expr(fold)).alias("x")).select("symbol", "x.date", "x.atr")


def with_atr(features: DataFrame, bars: DataFrame) -> DataFrame:
    """Features with the ATR as of the session before."""
    atr = wilder_atr(true_range(bars))
    days = bars.select("symbol", "date").distinct().join(atr, ["symbol", "date"], "left")
    past = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return features.join(days.withColumn("atr", F.last("atr", ignorenulls=True).over(past)), ["symbol", "date"])
