"""A classifier of trades: features, labels, purged cross-validation, parameter search, and the probability gate.

Gradient-boosted trees as Spark ML's stand for the boosting library (boosting.py); leaves become a depth and bagging a sampling rate.
"""

from __future__ import annotations

import math
import random
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting, metrics, walkforward

FEATURES = ["stop_distance", "target_distance", "reward_ratio", "session_time"]
OPEN, LENGTH = 570, 390
SEED, SPLITS, ROUNDS, GATE, MIN_TRADES, MIN_TRAIN, MIN_VALIDATION = 42, 5, 200, 0.55, 20, 10, 5
TRIALS, START_UP, WARM_UP = 50, 5, 1
#: Defaults and the search ranges (low, high, kind).
DEFAULTS = {"num_leaves": 31, "learning_rate": 0.05, "min_child_samples": 20, "scale_pos_weight": None, "feature_fraction": 1.0, "bagging_fraction": 1.0, "bagging_freq": 0}
RANGES = {
    "num_leaves": (15, 63, "int"), "learning_rate": (0.01, 0.30, "log"), "min_child_samples": (10, 60, "int"), "scale_pos_weight": (1.0, 10.0, "float"),
    "feature_fraction": (0.50, 1.0, "float"), "bagging_fraction": (0.50, 1.0, "float"), "bagging_freq": (1, 7, "int"),
}


def features(trades: DataFrame) -> DataFrame:
    """Trades with FEATURES, from entry_price, stop_price, target_price and entry_time in minutes of the day."""
    stop, target = F.col("entry_price") - F.col("stop_price"), F.col("target_price") - F.col("entry_price")
    time = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("entry_time") - OPEN) / LENGTH))
    ratio = F.when(stop > 1e-9, target / F.when(stop > 1e-9, stop)).otherwise(0.0)
    per = F.nullif("entry_price", F.lit(0.0))
    return trades.withColumns({"stop_distance": F.coalesce(stop / per, F.lit(0.0)), "target_distance": F.coalesce(target / per, F.lit(0.0)), "reward_ratio": ratio, "session_time": time})


def labelled(trades: DataFrame) -> DataFrame:
    """Trades with label 1.0 where they win at the baseline cost."""
    return trades.withColumn("label", (metrics.net(metrics.SCENARIOS["baseline"]) > 0).cast("double"))


def log_loss(p: str, y: str = "label") -> Column:
    """Mean log loss; probabilities are kept 1e-7 away from 0 and 1."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    return -F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def fit(train: DataFrame, parameters: dict | None = None, rounds: int = ROUNDS) -> boosting.Model | None:
    """A classifier of the rows; None if they hold one class only."""
    p = DEFAULTS | (parameters or {})
    return boosting.fit(
        train, FEATURES, rounds=rounds, rate=p["learning_rate"], depth=max(1, math.ceil(math.log2(p["num_leaves"]))), least=p["min_child_samples"], weight=p["scale_pos_weight"],
        row_share=p["bagging_fraction"] if p["bagging_freq"] else 1.0, feature_share=p["feature_fraction"], seed=SEED,
    )


def scored(trades: DataFrame, model: boosting.Model | None) -> DataFrame:
    """Trades with the probability of a win; NULL without a model."""
    return trades.withColumn("p_win", F.lit(None).cast("double") if model is None else model.probability())


def split_losses(trades: DataFrame, parameters: dict | None = None, rounds: int = ROUNDS, splits: int = SPLITS):
    """Log losses of the purged splits, one after the other; splits with too few trades are left out."""
    parts = walkforward.purged_splits(walkforward.day_numbers(trades), splits)
    each = trades.join(F.broadcast(parts.withColumnRenamed("date", "_date")), F.col("exit_date") == F.col("_date"))
    counts = {(r.split, r.part): r["count"] for r in each.groupBy("split", "part").count().collect()}  # two rows a split
    for k in range(1, splits + 1):
        if counts.get((k, "train"), 0) >= MIN_TRAIN and counts.get((k, "validation"), 0) >= MIN_VALIDATION:
            model = fit(each.where(f"split = {k} AND part = 'train'"), parameters, rounds)
            if model is not None:
                yield scored(each.where(f"split = {k} AND part = 'validation'"), model).agg(log_loss("p_win")).first()[0]


def drawn(rng: random.Random) -> dict:
    """One setting, drawn from RANGES."""
    kinds = {"int": rng.randint, "float": rng.uniform, "log": lambda a, b: math.exp(rng.uniform(math.log(a), math.log(b)))}
    return {name: kinds[kind](low, high) for name, (low, high, kind) in RANGES.items()}


def search(trades: DataFrame, trials: int = TRIALS, rounds: int = ROUNDS, losses=split_losses) -> tuple[dict, float, list[dict]]:
    """Best setting, its mean loss, and all trials. A trial worse than the median of those before it at a split is stopped."""
    rng, log = random.Random(SEED), []
    for _ in range(min(trials, TRIALS)):
        setting, means, got, stopped = drawn(rng), [], [], False
        for loss in losses(trades, setting, rounds):
            got.append(loss)
            means.append(statistics.fmean(got))
            before = [t["means"][len(means) - 1] for t in log if len(t["means"]) >= len(means)]
            if len(log) >= START_UP and len(means) > WARM_UP and before and means[-1] > statistics.median(before):
                stopped = True
                break
        log.append({"setting": setting, "means": means, "stopped": stopped})
    whole = [t for t in log if t["means"] and not t["stopped"]]
    if not whole:
        return dict(DEFAULTS), math.nan, log
    best = min(whole, key=lambda t: t["means"][-1])
    return best["setting"], best["means"][-1], log


def filtered(train: DataFrame, trades: DataFrame, parameters: dict | None = None, rounds: int = ROUNDS, gate: float = GATE) -> DataFrame:
    """Trades whose probability of a win reaches the gate; all of them if there is too little to learn from."""
    model = fit(train, parameters, rounds) if train.count() >= MIN_TRADES else None
    out = scored(trades, model)
    return out if model is None else out.where(F.col("p_win") >= gate)
