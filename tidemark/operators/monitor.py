"""Comparison of runs and drift of selected folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ic import p_value

MODERATE, SIGNIFICANT, LEAST_REFERENCE = -1.0, -2.0, 3
#: The metrics whose drift is watched, and those by which runs are compared.
TRACKED = ["sharpe", "profit_factor", "mean_net_bps", "win_rate"]
COMPARED = ["sharpe", "profit_factor", "mean_net_bps", "win_rate", "total_net_pnl"]


def paired_test(base: DataFrame, variant: DataFrame, keys: list[str], on: str = "fold", value: str = "value") -> DataFrame:
    """n, mean difference, t and p over the folds that both runs have."""
    both = base.select(*keys, on, F.col(value).alias("a")).join(variant.select(*keys, on, F.col(value).alias("b")), [*keys, on])
    d = both.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("b") - F.col("a"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("_sd"))
    t = F.try_divide(F.col("mean_diff") * F.sqrt("n"), F.nullif("_sd", F.lit(0.0)))
    return out.withColumn("t_stat", t).drop("_sd").withColumn("p_value", p_value(F.col("t_stat")))


def drift(values: DataFrame, keys: list[str], recent: int = 3) -> DataFrame:
    """Standard score of the mean of the last `recent` folds against the earlier ones, and what it says.

    A fold without a value counts as a fold and not in the means.
    """
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fold")))
    v = values.withColumn("_new", newest <= recent)
    now, then = F.when(F.col("_new"), F.col("value")), F.when(~F.col("_new"), F.col("value"))
    out = v.groupBy(*keys).agg(F.count_if(~F.col("_new")).alias("n_reference"), F.avg(now).alias("recent_mean"), F.avg(then).alias("reference_mean"), F.stddev_samp(then).alias("_sd"))
    z = F.when(F.col("n_reference") >= LEAST_REFERENCE, F.try_divide(F.col("recent_mean") - F.col("reference_mean"), F.nullif("_sd", F.lit(0.0))))
    verdict = F.when(F.col("z").isNull(), "insufficient_data").when(F.col("z") >= MODERATE, "stable").when(F.col("z") >= SIGNIFICANT, "moderate").otherwise("significant")
    return out.withColumn("z", z).drop("_sd").withColumn("verdict", verdict)


def metadata_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields (name, value) that differ between two runs or are in one only."""
    joined = a.select("name", F.col("value").alias("a")).join(b.select("name", F.col("value").alias("b")), "name", "full")
    return joined.where("NOT (a <=> b)")


def comparison_verdict(tests: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """What paired tests (metric, n, mean_diff, p_value) of sharpe and mean_net_bps say of a variant, by key."""
    sure = F.col("p_value") < alpha
    better = F.bool_or(F.col("metric").isin("sharpe", "mean_net_bps") & sure & (F.col("mean_diff") > 0))
    worse = F.bool_or((F.col("metric") == "sharpe") & sure & (F.col("mean_diff") < 0))
    out = tests.groupBy(*keys).agg(F.max("n").alias("_n"), better.alias("_better"), worse.alias("_worse"))
    verdict = F.when(F.col("_n") < 2, "insufficient_data").when(F.col("_better"), "significantly_better").when(F.col("_worse"), "significantly_worse").otherwise("no_significant_improvement")
    return out.select(*keys, verdict.alias("verdict"))


SEVERITY = ("stable", "insufficient_data", "moderate", "significant")


def worst(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The worst verdict of several metrics by key; a metric that says nothing counts as stable if there are enough folds."""
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("verdict"))
    place = F.when(F.col("verdict") == "insufficient_data", F.lit(1)).otherwise(place)
    found = F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(place).cast("int"))
    return verdicts.groupBy(*keys).agg(F.when(F.max("n_reference") < LEAST_REFERENCE, "insufficient_data").otherwise(found).alias("verdict"))


def unpivoted(found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) of the named columns."""
    return found.unpivot([*keys], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
