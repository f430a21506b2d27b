"""Rank information coefficients: series, summaries and false-discovery control."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the Chebyshev fit to erfc in Press et al., Numerical Recipes, section 6.2.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def p_value(t: Column) -> Column:
    """Two-sided normal p-value, relative error about 1e-7."""
    z = F.abs(t) / F.sqrt(F.lit(2.0))
    u = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + u * poly
    return F.least(F.lit(1.0), u * F.exp(-z * z + poly))


def until(panel: DataFrame, end: date, cutoff: date) -> DataFrame:
    """Days of the panel up to `end`; an end past the cutoff, where untouched data begin, is an error."""
    if end > cutoff:
        raise ValueError(f"{end} is past the cutoff {cutoff}")
    return panel.where(F.col("date") <= F.lit(end))


def rank_ic(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """IC by key and date of columns a and b (ranks), over rows that have both; 0 without spread, NULL under two rows."""
    both = ranked.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*keys, "date").agg(
        F.count("*").alias("n"), F.covar_samp("a", "b").alias("cov"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb")
    )
    spread = F.col("sa") * F.col("sb")
    ic = F.when((F.col("n") - 1) * spread > 1e-12, F.try_divide(F.col("cov"), spread)).otherwise(0.0)
    return both.where("n >= 2").select(*keys, "date", ic.alias("ic"))


def rank_ic_of(wide: DataFrame, digits: int = 10) -> DataFrame:
    """IC by factor, horizon and date of rows (symbol, date, factors, returns).

    `factors` is an array of (factor, value), `returns` one of (horizon, b) with ranks of forward returns. Values are
    rounded and ranked within factor and date, ties by symbol; the sums by horizon reuse that exchange.
    """
    by = Window.partitionBy("factor", "date")
    rows = wide.select("symbol", "date", "returns", F.inline("factors")).withColumn("value", F.round("value", digits))
    n, k = F.count("value").over(by), F.row_number().over(by.orderBy(F.asc_nulls_last("value"), "symbol"))
    ranked = rows.where("value IS NOT NULL").withColumn("_n", n).withColumn("a", F.when(F.col("_n") >= 2, (k - 1) / (F.col("_n") - 1)))
    return rank_ic(ranked.select("factor", "date", "a", F.inline("returns")), ["factor", "horizon"])


def summary(series: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, sample deviation, information ratio, t and p by key."""
    s = series.where("ic IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    ir = F.try_divide(F.col("mean_ic"), F.nullif("std_ic", F.lit(0.0)))
    s = s.withColumn("ic_ir", ir).withColumn("t_stat", F.col("ic_ir") * F.sqrt("n_obs"))
    return s.withColumn("p_value", p_value(F.col("t_stat")))


def hac(series: DataFrame, keys: list[str], lag: int | Column, most: int | None = None) -> DataFrame:
    """Summary with Newey-West t and p, Bartlett weights, autocovariances over n - 1.

    The number of lags may be an expression of the keys whose largest value is `most`."""
    most = lag if isinstance(lag, int) else most
    lags = F.lit(lag) if isinstance(lag, int) else lag
    s = series.where("ic IS NOT NULL")
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    u = s.withColumn("u", F.col("ic") - F.avg("ic").over(group))
    u = u.select(*keys, "ic", "u", *(F.lag("u", k).over(order).alias(f"u{k}") for k in range(1, most + 1)))
    weighted = F.sum(F.col("u") * F.col("u"))
    for k in range(1, most + 1):
        weight = F.when(F.lit(k) <= lags, 2.0 * (1.0 - k / (lags + 1))).otherwise(0.0)
        weighted = weighted + F.first(weight) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0))
    out = u.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg("ic").alias("mean_ic"), weighted.alias("w"))
    spread = F.try_divide(F.col("w"), F.col("n_obs") - 1)
    t = F.when(spread > 0, F.col("mean_ic") * F.sqrt("n_obs") / F.sqrt(F.nullif(F.greatest(spread, F.lit(0.0)), F.lit(0.0))))
    return out.select(*keys, "n_obs", "mean_ic", t.alias("hac_t_stat")).withColumn("hac_p_value", p_value(F.col("hac_t_stat")))


def every(series: DataFrame, keys: list[str], h: int | Column) -> DataFrame:
    """Every h-th value of each series from its first; h may be an expression of the keys."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    return series.where("ic IS NOT NULL").withColumn("_k", k).where(F.col("_k") % h == 0).drop("_k")


def discoveries(tests: DataFrame, order: list[str], q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values. A row per hypothesis, so one window over all of them; no p counts as 1."""
    p = tests.withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
    up = Window.orderBy("p_value", *order)
    m = p.withColumn("_k", F.row_number().over(up)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("_m") / F.col("_k")).over(down))
    return m.withColumn("bh_p", adjusted).withColumn("rejected", F.col("bh_p") <= q).drop("_k", "_m")
