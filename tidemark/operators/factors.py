"""Forty-two published formulaic factors (Kakushadze, "101 Formulaic Alphas", 2015) on a daily panel.

All factors share one column plan, so shared parts are computed once and passes by symbol and by date alternate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import Series
from tidemark.plans.staged import Columns

BASE = ["symbol", "date", "open", "high", "low", "close", "volume"]
#: The factors that passed selection.
SELECTED = ["alpha003", "alpha024", "alpha032", "alpha035", "alpha042", "alpha050"]


def build() -> tuple[Columns, dict[str, str]]:
    """The plan of all factors, and the column of each."""
    cols = Columns(BASE)
    s = Series(cols)
    o, h, l, c, v = BASE[2:]
    rank, corr, row = s.rank, s.corr, s.row
    w = row("(open + high + low + close) / 4")
    before = s.delay(c, 1)
    r = row(f"CASE WHEN {before} > 0 THEN (close - {before}) / nullif({before}, 0) END")
    d1 = s.delta(c, 1)
    c10, c20 = s.delay(c, 10), s.delay(c, 20)
    bend = row(f"({c20} - {c10}) / 10 - ({c10} - close) / 10")
    co = row("close - open")
    gap = row(f"{w} - close")
    rv = rank(v)
    f: dict[str, str] = {}

    def turn(d: int) -> str:
        return row(f"CASE WHEN {s.low(d1, d)} > 0 THEN {d1} WHEN {s.high(d1, d)} < 0 THEN {d1} ELSE -{d1} END")

    def jump(bound: float) -> str:
        return row(f"CASE WHEN {bend} < {bound} THEN 1.0e0 ELSE -{d1} END")

    chosen = row(f"CASE WHEN {r} < 0 THEN {s.std(r, 20)} ELSE close END")
    f["001"] = row(f"{rank(s.arg_high(s.signed_power(chosen, 2), 5))} - 0.5e0")
    f["002"] = row(f"-{corr(rank(s.delta(s.log(v), 2)), rank(s.ratio(co, o)), 6)}")
    f["003"] = row(f"-{corr(rank(o), rv, 10)}")
    f["004"] = row(f"-{s.ts_rank(rank(l), 9)}")
    f["005"] = row(f"{rank(row(f'open - {s.mean(w, 10)}'))} * -abs({rank(row(f'close - {w}'))})")
    f["006"] = row(f"-{corr(o, v, 10)}")
    pull = row(f"{s.total(o, 5)} * {s.total(r, 5)}")
    f["008"] = row(f"-{rank(s.delta(pull, 10))}")
    f["009"] = turn(5)
    f["010"] = rank(turn(4))
    f["011"] = row(f"({rank(s.high(gap, 3))} + {rank(s.low(gap, 3))}) * {rank(s.delta(v, 3))}")
    f["012"] = row(f"{s.sign(s.delta(v, 1))} * -{d1}")
    f["013"] = row(f"-{rank(s.cov(rank(c), rv, 5))}")
    f["014"] = row(f"-{rank(s.delta(r, 3))} * {corr(o, v, 10)}")
    f["015"] = row(f"-{s.total(rank(corr(rank(h), rv, 3)), 3)}")
    f["016"] = row(f"-{rank(s.cov(rank(h), rv, 5))}")
    f["018"] = row(f"-{rank(row(f'{s.std(row(f"abs({co})"), 5)} + {co} + {corr(c, o, 10)}'))}")
    week = s.delta(c, 7)
    f["019"] = row(f"-{s.sign(row(f'{week} + {week}'))} * (1 + {rank(row(f'1 + {s.total(r, 250)}'))})")
    f["020"] = row(f"-{rank(row(f'open - {s.delay(h, 1)}'))} * {rank(row(f'open - {before}'))} * {rank(row(f'open - {s.delay(l, 1)}'))}")
    f["022"] = row(f"-({s.delta(corr(h, v, 5), 5)} * {rank(s.std(c, 20))})")
    level = s.mean(h, 20)
    f["023"] = row(f"CASE WHEN {level} IS NULL THEN NULL WHEN {level} < high THEN -{s.delta(h, 2)} ELSE 0.0e0 END")
    slow = s.ratio(s.delta(s.mean(c, 100), 100), s.delay(c, 100))
    f["024"] = row(f"CASE WHEN {slow} < 0.05e0 THEN -(close - {s.low(c, 100)}) ELSE -{s.delta(c, 3)} END")
    f["026"] = row(f"-{s.high(corr(s.ts_rank(v, 5), s.ts_rank(h, 5), 5), 3)}")
    half = rank(row(f"{s.total(corr(rv, rank(w), 6), 2)} / 2"))
    f["027"] = row(f"CASE WHEN {half} > 0.5e0 THEN -1.0e0 WHEN {half} IS NOT NULL THEN 1.0e0 END")
    c2, c3 = s.delay(c, 2), s.delay(c, 3)
    steps = row(f"{s.sign(d1)} + {s.sign(row(f'{before} - {c2}'))} + {s.sign(row(f'{c2} - {c3}'))}")
    f["030"] = row(f"(1 - {rank(steps)}) * {s.total(v, 5)} / nullif({s.total(v, 20)}, 0)")
    f["032"] = row(f"{s.scale(row(f'{s.mean(c, 7)} - close'))} + 20 * {s.scale(corr(w, s.delay(c, 5), 230))}")
    f["033"] = rank(row("-(1 - open / nullif(close, 0))"))
    f["034"] = rank(row(f"(1 - {rank(s.ratio(s.std(r, 2), s.std(r, 5)))}) + (1 - {rank(d1)})"))
    f["035"] = row(f"{s.ts_rank(v, 32)} * (1 - {s.ts_rank(row('close + high - low'), 16)}) * (1 - {s.ts_rank(r, 32)})")
    oc = row("open - close")
    f["037"] = row(f"{rank(corr(s.delay(oc, 1), c, 200))} + {rank(oc)}")
    f["038"] = row(f"-{rank(s.ts_rank(c, 10))} * {rank(s.ratio(c, o))}")
    f["040"] = row(f"-{rank(s.std(h, 10))} * {corr(h, v, 10)}")
    f["041"] = row(f"CASE WHEN high * low >= 0 THEN sqrt(abs(high * low)) END - {w}")
    f["042"] = row(f"{rank(gap)} / nullif({rank(row(f'{w} + close'))}, 0)")
    f["044"] = row(f"-{corr(h, rv, 5)}")
    f["045"] = row(f"-({rank(s.mean(s.delay(c, 5), 20))} * {corr(c, v, 2)} * {rank(corr(s.total(c, 5), s.total(c, 20), 2), 6)})")
    f["046"] = row(f"CASE WHEN {bend} > 0.25e0 THEN -1.0e0 WHEN {bend} < 0 THEN 1.0e0 ELSE -{d1} END")
    f["049"], f["051"] = jump(-0.1), jump(-0.05)
    f["050"] = row(f"-{s.high(rank(corr(rv, rank(w), 5)), 5)}")
    f["053"] = row(f"-{s.delta(row('(close - low - (high - close)) / nullif(close - low, 0)'), 9)}")
    f["054"] = row("-(low - close) * power(open, 5) / nullif((low - high) * power(close, 5), 0)")
    floor = s.low(l, 12)
    f["055"] = row(f"-{corr(rank(row(f'(close - {floor}) / nullif({s.high(h, 12)} - {floor}, 0)')), rv, 6)}")
    return cols, {f"alpha{k}": n for k, n in f.items()}


PLAN, FACTORS = build()


def factors(panel: DataFrame, names: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """symbol, date and a column for each factor; all of them unless named."""
    names = names or sorted(FACTORS)
    out = PLAN.apply(panel.select(*BASE), [FACTORS[n] for n in names])
    value = (lambda n: F.round(FACTORS[n], digits)) if digits is not None else (lambda n: F.col(FACTORS[n]))
    return out.select("symbol", "date", *(value(n).alias(n) for n in names))


def factors_sql(panel: str, names: list[str], digits: int) -> str:
    return f"SELECT symbol, date, {', '.join(f'round({FACTORS[n]}, {digits}) AS {n}' for n in names)} FROM ({PLAN.sql(panel, [FACTORS[n] for n in names])})"
