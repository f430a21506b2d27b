"""Opening-range breakout: the candidate grid, its signals, and the trades that follow from them.

A signal is a condition on one bar and one candidate, so signals come from a join with the candidates (a fixed table).
State never crosses a session: each session and candidate with a signal is one fold over the session's bars.
"""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTIONAL = 10_000.0
#: The parameter grid.
GRID = {
    "opening_range_minutes": (15, 30), "breakout_atr_buffer": (0.05, 0.10), "stop_atr_fraction": (0.6,), "stop_range_fraction": (0.5,), "target_r": (1.0, 1.5, 2.0),
    "max_hold_minutes": (60, 120), "signal_cutoff_minutes": (60, 90), "min_relative_volume": (1.2, 1.5), "min_breakout_close_location": (0.6, 0.7), "require_rising_vwap": (True,),
}


def grid(values: dict[str, tuple] = GRID) -> list[dict]:
    return [dict(zip(values, v, strict=True)) for v in itertools.product(*values.values())]


def candidate_id(candidate: dict) -> str:
    return "c" + hashlib.sha256(json.dumps(candidate, sort_keys=True).encode()).hexdigest()[:12]


def grid_hash(candidates: list[dict]) -> str:
    return hashlib.sha256(json.dumps(candidates, sort_keys=True).encode()).hexdigest()[:16]


def candidates(spark: SparkSession, values: dict[str, tuple] = GRID, shard: int = 0, shards: int = 1) -> DataFrame:
    """The grid, or every `shards`-th candidate of it from number `shard`."""
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    rows = [{"candidate_id": candidate_id(c)} | c for c in grid(values)[shard::shards]]
    kinds = {int: "int", float: "double", bool: "boolean"}
    schema = "candidate_id string, " + ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in values.items())
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def signals(features: DataFrame, grid_table: DataFrame, ranges: list[int]) -> DataFrame:
    """Bars and candidates whose entry conditions hold, whatever position is open."""
    high = F.coalesce(*(F.when(F.col("opening_range_minutes") == w, F.col(f"or_high_{w}")) for w in ranges))
    low = F.coalesce(*(F.when(F.col("opening_range_minutes") == w, F.col(f"or_low_{w}")) for w in ranges))
    able = features.where("atr IS NOT NULL AND rvol IS NOT NULL AND vwap IS NOT NULL AND close >= vwap")
    pairs = able.join(F.broadcast(grid_table), (F.col("minutes") > F.col("opening_range_minutes")) & (F.col("minutes") <= F.col("signal_cutoff_minutes")) & (F.col("rvol") >= F.col("min_relative_volume")))
    pairs = pairs.withColumn("or_high", high).withColumn("or_low", low)
    location = F.when(F.col("high") <= F.col("low"), 1.0).otherwise((F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return pairs.where(
        (F.col("or_high") > F.col("or_low")) & (F.col("close") > F.col("or_high") + F.col("breakout_atr_buffer") * F.col("atr"))
        & (location >= F.col("min_breakout_close_location")) & (~F.col("require_rising_vwap") | F.coalesce(F.col("vwap") > F.col("prev_vwap"), F.lit(False)))
    )


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def trades(features: DataFrame, found: DataFrame, minutes: int) -> DataFrame:
    """The trade log: fills at the next bar's open, stop before target, time limit, flat at the session's end."""
    days = features.groupBy("symbol", "date").agg(F.sort_array(F.collect_list(F.struct("idx", "bar_end", "open", "high", "low", "close"))).alias("bars"))
    own = found.groupBy("symbol", "date", "candidate_id").agg(
        F.collect_set("idx").alias("at"), F.first("target_r").alias("target_r"), F.first("max_hold_minutes").alias("hold"),
        F.first(F.least(F.col("stop_atr_fraction") * F.col("atr"), F.col("stop_range_fraction") * (F.col("or_high") - F.col("or_low")))).alias("dist"),
    )
    trade = "struct<signal_idx:int,entry_time:int,entry_price:double,stop_price:double,target_price:double,exit_time:int,exit_price:double,exit_reason:string,quantity:bigint>"
    position = "struct<signal_idx:int,entry_time:int,entry:double,stop:double,target:double,quantity:bigint>"
    none = f"CAST(NULL AS {position})"
    can_fill = f"s.pending IS NOT NULL AND dist > 0 AND b.open > 0 AND floor({NOTIONAL}D / b.open) > 0"
    filled = f"CASE WHEN {can_fill} THEN CAST(named_struct('signal_idx', s.pending, 'entry_time', b.bar_end - {minutes}, 'entry', b.open, 'stop', b.open - dist, 'target', b.open + target_r * dist, 'quantity', CAST(floor({NOTIONAL}D / b.open) AS BIGINT)) AS {position}) ELSE s.pos END"
    out = """CASE WHEN p IS NULL THEN NULL
        WHEN b.open <= p.stop THEN named_struct('price', b.open, 'why', 'stop') WHEN b.low <= p.stop THEN named_struct('price', p.stop, 'why', 'stop')
        WHEN b.open >= p.target THEN named_struct('price', b.open, 'why', 'target') WHEN b.high >= p.target THEN named_struct('price', p.target, 'why', 'target')
        WHEN b.bar_end - p.entry_time >= hold THEN named_struct('price', b.close, 'why', 'max_hold') END"""

    def closed(end: str, price: str, why: str, p: str = "p") -> str:
        return f"CAST(named_struct('signal_idx', {p}.signal_idx, 'entry_time', {p}.entry_time, 'entry_price', {p}.entry, 'stop_price', {p}.stop, 'target_price', {p}.target, 'exit_time', {end}, 'exit_price', {price}, 'exit_reason', {why}, 'quantity', {p}.quantity) AS {trade})"

    after = f"""named_struct('pending', CASE WHEN (p IS NULL OR x IS NOT NULL) AND array_contains(at, b.idx) THEN b.idx END,
        'pos', CASE WHEN x IS NULL THEN p ELSE {none} END,
        'done', CASE WHEN x IS NULL THEN s.done ELSE concat(s.done, array({closed('b.bar_end', 'x.price', 'x.why')})) END)"""
    state = f"named_struct('pending', CAST(NULL AS INT), 'pos', {none}, 'done', CAST(array() AS array<{trade}>))"
    final = f"CASE WHEN s.pos IS NULL THEN s.done ELSE concat(s.done, array({closed('element_at(bars, -1).bar_end', 'element_at(bars, -1).close', repr('session_close'), 's.pos')})) END"
    fold = f"aggregate(bars, {state}, (s, b) -> {_let('p', filled, _let('x', out, after))}, s -> {final})"
    log = own.join(days, ["symbol", "date"]).select("candidate_id", "symbol", "date", F.explode(F.expr(fold)).alias("t")).select("candidate_id", "symbol", "date", "t.*")
    return log.withColumn("gross_pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("quantity")).withColumn("entry_notional", F.col("entry_price") * F.col("quantity")).withColumn("exit_notional", F.col("exit_price") * F.col("quantity"))
