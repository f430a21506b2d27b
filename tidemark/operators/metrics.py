"""Trade metrics under cost scenarios: all are aggregates by group, so candidates and folds run side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPITAL, YEAR = 100_000.0, 252
SCENARIOS = {"zero": 0.0, "baseline": 2.5, "double": 5.0}


def net(bps: Column | float) -> Column:
    """Profit after costs of `bps` per side."""
    bps = F.lit(bps) if isinstance(bps, float) else bps
    return F.col("gross_pnl") - (F.col("entry_notional") + F.col("exit_notional")) * bps / 10_000.0


def with_costs(trades: DataFrame, scenarios: dict[str, float] = SCENARIOS) -> DataFrame:
    """Each trade under each scenario, with its net profit."""
    pairs = F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("bps")) for k, v in scenarios.items()))
    return trades.withColumn("_s", F.explode(pairs)).withColumn("net", net(F.col("_s.bps"))).select("*", "_s.scenario").drop("_s")


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, win rate, profit factor (NULL without losses), mean basis points and total of `net` by key."""
    gain, loss = F.sum(F.when(F.col("net") > 0, F.col("net"))), F.sum(F.when(F.col("net") < 0, -F.col("net")))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.try_divide(F.coalesce(gain, F.lit(0.0)), loss).alias("profit_factor"),
        F.avg(F.try_divide(F.col("net"), F.col("entry_notional")) * 10_000).alias("mean_net_bps"), F.sum("net").alias("total_net_pnl"),
    )


def daily_returns(trades: DataFrame, keys: list[str], days: DataFrame) -> DataFrame:
    """Return of each key on each of the days, 0 without an exit; `days` may hold some of the keys."""
    sums = trades.groupBy(*keys, F.col("exit_date").alias("date")).agg((F.sum("net") / CAPITAL).alias("ret"))
    shared = [k for k in keys if k in days.columns]
    every = trades.select(*keys).distinct()
    grid = every.join(days, shared) if shared else every.crossJoin(F.broadcast(days))
    return grid.join(sums, [*keys, "date"], "left").select(*keys, "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def daily_cells(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of each key and exit day from which all metrics follow, so that trades are read and dealt once."""
    bps = F.try_divide(F.col("net"), F.col("entry_notional")) * 10_000
    return trades.groupBy(*keys, F.col("exit_date").alias("date")).agg(
        F.count("*").alias("n"), F.count("net").alias("n_net"), F.count_if(F.col("net") > 0).alias("wins"), F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("gain"),
        F.sum(F.when(F.col("net") < 0, -F.col("net"))).alias("loss"), F.sum(bps).alias("bps"), F.count(bps).alias("n_bps"), F.sum("net").alias("net"),
    )


def cell_metrics(cells: DataFrame, keys: list[str], days: DataFrame) -> DataFrame:
    """All metrics by key from its daily cells; `days` (some of the keys, days) has the number of days of each key.

    Days without a cell have return 0. They aren't written out: the population deviation follows from that of the k
    days with a cell, and the largest drawdown ends on one of them. Sharpe is NULL under two days or without deviation.
    """
    path = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ret = F.coalesce(F.col("net"), F.lit(0.0)) / CAPITAL
    falls = cells.withColumn("ret", ret).withColumn("equity", F.sum("ret").over(path)).withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(path)) - F.col("equity"))
    sums = falls.groupBy(*keys).agg(
        F.sum("n").alias("trades"), F.try_divide(F.sum("wins"), F.sum("n_net")).alias("win_rate"), F.try_divide(F.coalesce(F.sum("gain"), F.lit(0.0)), F.sum("loss")).alias("profit_factor"),
        F.try_divide(F.sum("bps"), F.sum("n_bps")).alias("mean_net_bps"), F.sum("net").alias("total_net_pnl"),
        F.count("*").alias("_k"), F.avg("ret").alias("_mean"), F.var_pop("ret").alias("_var"), F.max("fall").alias("max_drawdown"),
    )
    shared = [k for k in keys if k in days.columns]
    out = sums.join(F.broadcast(days), shared) if shared else sums.crossJoin(F.broadcast(days))
    share = F.col("_k") / F.col("days")
    deviation = F.sqrt(share * (F.col("_var") + F.col("_mean") * F.col("_mean") * (1 - share)))
    sharpe = F.when(F.col("days") >= 2, F.try_divide(F.col("_mean") * share, F.nullif(deviation, F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))))
    return out.withColumn("sharpe", sharpe).drop("_k", "_mean", "_var")


def attribution(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.sum("net").alias("net"))
