"""Nested walk-forward: folds over exit days, gates, selection, outer test, purged splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.documents import METRICS
from tidemark.plans.lineage import cut

TRAIN, TEST, STEP, INNER = 252, 63, 63, 0.8
MIN_TRADES, MIN_SHARPE, MIN_FACTOR = 30, 0.0, 1.0
FINAL = {"trades": 100, "sharpe": 0.5, "profit_factor": 1.10, "mean_net_bps": 0.0}


def day_numbers(trades: DataFrame, day: str = "exit_date") -> DataFrame:
    """(date, n) for the distinct exit days, numbered from 0. There is a row per day, whatever the trades."""
    days = trades.select(F.col(day).alias("date")).distinct()
    return days.withColumn("n", F.row_number().over(Window.orderBy("date")) - 1)


def folds(days: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP) -> DataFrame:
    """(fold, part, date): each day in the parts `train`, `validation` and `test` of the folds that hold it.

    A day finds its folds by arithmetic, at most train / step + 1 of them, so no range join is needed.
    """
    total = days.agg(F.max("n").alias("last"))
    inner = int(train * INNER)
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (train + test - 1)) / step)).cast("int")
    last = F.least(F.floor(F.col("n") / step), F.floor((F.col("last") + 1 - train - test) / step)).cast("int")
    each = days.crossJoin(F.broadcast(total)).withColumn("a", first).withColumn("b", last).where("a <= b")
    each = each.select("date", "n", F.explode(F.sequence("a", "b")).alias("fold"))
    k = F.col("n") - F.col("fold") * step
    return each.select("fold", F.when(k < inner, "train").when(k < train, "validation").otherwise("test").alias("part"), "date")


def costed_cells(trades: DataFrame) -> DataFrame:
    """Daily cells of each candidate under each cost scenario: what every later step of a walk-forward reads."""
    return metrics.daily_cells(metrics.with_costs(trades), ["scenario", "candidate"])


def fold_metrics(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Metrics of every candidate by fold and part at the baseline cost."""
    own = cells.where("scenario = 'baseline'").join(F.broadcast(parts), "date")
    return metrics.cell_metrics(own, ["fold", "part", "candidate"], parts.groupBy("fold", "part").agg(F.count("*").alias("days")))


def gated(found: DataFrame) -> DataFrame:
    """The first gate that each candidate fails in each fold, or NULL; a row for each with trades to train on."""
    of = {p: [F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for c in ("trades", "sharpe", "profit_factor", "total_net_pnl")] for p in ("train", "validation")}
    both = found.groupBy("fold", "candidate").agg(*of["train"], *of["validation"]).where("train_trades IS NOT NULL")
    gate = (
        F.when(F.col("train_trades") < MIN_TRADES, "min_trades").when(~F.coalesce(F.col("train_sharpe") >= MIN_SHARPE, F.lit(False)), "train_sharpe")
        .when(~F.coalesce(F.col("train_profit_factor") >= MIN_FACTOR, F.lit(True)), "train_pf").when(~F.coalesce(F.col("validation_total_net_pnl") > 0, F.lit(False)), "val_pnl")
    )
    return both.select("fold", "candidate", gate.alias("gate"), F.col("validation_sharpe").alias("val_sharpe"))


def rejections(gates: DataFrame) -> DataFrame:
    return gates.where("gate IS NOT NULL").groupBy("fold", "gate").agg(F.count("*").alias("n"))


def selected(gates: DataFrame) -> DataFrame:
    """Each fold's candidate with the best validation Sharpe ratio; the least one among equals."""
    best = Window.partitionBy("fold").orderBy(F.desc(F.round("val_sharpe", 9)), "candidate")
    return gates.where("gate IS NULL AND val_sharpe IS NOT NULL").withColumn("k", F.row_number().over(best)).where("k = 1").select("fold", "candidate", "val_sharpe")


def outer(cells: DataFrame, parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Metrics by cost scenario of the chosen candidates' test trades, over the test days of all folds, chosen or not."""
    days = parts.where("part = 'test'").select("fold", "date")
    own = cells.join(F.broadcast(days), "date").join(F.broadcast(chosen.select("fold", "candidate")), ["fold", "candidate"])
    daily = own.groupBy("scenario", "date").agg(*(F.sum(c).alias(c) for c in ("n", "n_net", "wins", "gain", "loss", "bps", "n_bps", "net")))
    return metrics.cell_metrics(daily, ["scenario"], days.agg(F.countDistinct("date").alias("days")))


def decided(found: DataFrame) -> DataFrame:
    """outer() with the final gates that each row fails, by name, joined by commas; none: a candidate."""
    low = {"trades": F.col("trades") >= FINAL["trades"], "sharpe": F.col("sharpe") > FINAL["sharpe"], "mean_net_bps": F.col("mean_net_bps") > FINAL["mean_net_bps"]}
    failed = [F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in low.items()]
    return found.withColumn("failed", F.concat_ws(",", *failed, F.when(F.col("profit_factor") < FINAL["profit_factor"], "profit_factor")))


def outer_attribution(trades: DataFrame, parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Net profit by symbol of the chosen candidates' test trades at the baseline cost."""
    days = parts.where("part = 'test'").select("fold", "date")
    own = trades.join(F.broadcast(days), trades.exit_date == days.date).join(F.broadcast(chosen.select("fold", "candidate")), ["fold", "candidate"])
    return metrics.attribution(own.withColumn("net", metrics.net(metrics.SCENARIOS["baseline"])))


def report(trades: DataFrame, input_meta: list[dict], at: str) -> dict:
    """The walk-forward report of a trade log (candidate, symbol, exit_date, ...). What reaches the driver is by fold, cost or symbol."""
    cells = cut(costed_cells(trades))
    parts = cut(folds(day_numbers(cells, "date")))
    found = cut(fold_metrics(cells, parts))
    gates = gated(found)
    chosen = cut(selected(gates))
    names = ["trades", "win_rate", "profit_factor", "sharpe", "mean_net_bps", "total_net_pnl", F.col("max_drawdown").alias("max_drawdown_frac")]
    tests = chosen.join(found.where("part = 'test'"), ["fold", "candidate"], "left").select("fold", "candidate", *names).collect()
    spans = parts.groupBy("fold").agg(*(F.expr(f"CAST({f}(date) FILTER (WHERE part = '{p}') AS STRING)").alias(f"{p}_{f}") for p in ("train", "validation", "test") for f in ("min", "max"))).orderBy("fold").collect()
    lost: dict[int, dict] = {}
    for r in rejections(gates).collect():
        lost.setdefault(r.fold, {})[r.gate] = r.n
    of = {r.fold: r.asDict() for r in tests}
    by_cost = {r.scenario: r for r in decided(outer(cells, parts, chosen)).select("scenario", "failed", *names).collect()}
    failed = [x for x in by_cost["baseline"].failed.split(",") if x] if by_cost else ["trades"]
    measured = {c: {k: v for k, v in by_cost[c].asDict().items() if k not in ("scenario", "failed")} if by_cost else {"trades": 0} | dict.fromkeys(METRICS) for c in metrics.SCENARIOS}
    each = [s.asDict() | {"rejections": lost.get(s.fold, {}), "selected": of.get(s.fold, {}).get("candidate"), "test_metrics": {k: of[s.fold][k] for k in METRICS} if s.fold in of else None} for s in spans]
    return {
        "schema_version": 1, "generated_at": at, "input_meta": input_meta, "folds": each, "fold_definition": {"train_days": TRAIN, "test_days": TEST, "step_days": STEP},
        "selection_gates": {"min_trades": MIN_TRADES, "min_train_sharpe": MIN_SHARPE, "min_train_pf": MIN_FACTOR, "validation": "net profit above 0"},
        "decision_gates": {"min_outer_trades": FINAL["trades"], "min_outer_sharpe": FINAL["sharpe"], "min_outer_pf": FINAL["profit_factor"]},
        "outer_test_metrics_by_cost": measured, "symbol_attribution_baseline": {r.symbol: r.net for r in outer_attribution(trades, parts, chosen).orderBy("symbol").collect()},
        "decision": "No-Go" if failed else "Candidate", "decision_reasons": failed,
    }


def totals(trades: DataFrame, start: str = "exit_date", end: str = "exit_date") -> DataFrame:
    """Number of trades of a run, its first and last day."""
    return trades.agg(F.count("*").alias("trade_count"), F.min(start).alias("start"), F.max(end).alias("end"))


def decision(row: dict) -> list[str]:
    """The final gates that aggregated outer metrics fail; none: a candidate."""
    failed = [k for k in ("trades",) if row[k] < FINAL[k]]
    failed += [k for k in ("sharpe", "mean_net_bps") if not (row[k] is not None and row[k] > FINAL[k])]
    return failed + [k for k in ("profit_factor",) if row[k] is not None and row[k] < FINAL[k]]


def purged_splits(days: DataFrame, splits: int = 5, gap_days: int = 25) -> DataFrame:
    """(split, part, date): blocks of days in order; training days end gap_days calendar days before validation."""
    total = days.agg(F.count("*").alias("total"))
    block = F.floor(F.col("n") / F.floor(F.col("total") / (splits + 1)))
    placed = days.crossJoin(F.broadcast(total)).where(F.col("total") >= splits + 2).withColumn("block", F.least(block, F.lit(splits)).cast("int"))
    starts = placed.where("block > 0").groupBy(F.col("block").alias("split")).agg(F.min("date").alias("start"))
    joined = placed.join(F.broadcast(starts), F.col("block") <= F.col("split"))
    part = F.when(F.col("block") == F.col("split"), "validation").when(F.col("date") < F.date_sub("start", gap_days), "train")
    return joined.select("split", part.alias("part"), "date").where("part IS NOT NULL")
