"""All queries of the engine by name, with SQL for each that SQL can express.

Prices of `daily` queries come from line items by brand and day; intraday ones from events. Doubles are rounded so that
two engines agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.series import Series
from tidemark.operators import bars, filtering, ic, intraday, lifecycle, metrics, monitor, quality, walkforward
from tidemark.operators.factors import FACTORS, PLAN, factors, factors_sql
from tidemark.plans.lineage import cut
from tidemark.plans.staged import Columns
from tidemark.sources import feed, market

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
SERIES_BASE = ["symbol", "date", "open", "high", "low", "close", "volume"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def off(digits: int) -> float:
    return 1.37 * 10.0 ** -(digits + 2)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero. What lies just halfway is moved off, as engines round it differently."""
    return df.select(*((F.round(F.col(c) + off(digits), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_sql(sql: str, doubles: str, others: str, digits: int = 6) -> str:
    cols = [*others.split(), *(f"round({c} + {off(digits):.4e}, {digits}) + 0.0e0 AS {c}" for c in doubles.split())]
    return f"SELECT {', '.join(cols)} FROM ({sql})"


# ---------------------------------------------------------------- bars

TRADES = "SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS volume, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey"
DAILY = f"SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(volume) AS volume, count(*) AS n_ticks FROM ({TRADES}) GROUP BY symbol, date"
PANEL = f"""SELECT symbol, date, coalesce(open, last) AS open, coalesce(high, last) AS high, coalesce(low, last) AS low, coalesce(close, last) AS close,
  CASE WHEN last IS NOT NULL THEN coalesce(volume, 0) END AS volume
  FROM (SELECT g.symbol, g.date, open, high, low, close, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
    FROM (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM ({DAILY})) CROSS JOIN (SELECT DISTINCT date FROM ({DAILY}))) g LEFT JOIN ({DAILY}) b ON g.symbol = b.symbol AND g.date = b.date)"""


def daily(spark, d) -> DataFrame:
    return bars.roll_up(market.daily_ticks(spark, d), ["symbol", "date"], ["k1", "k2", "k3", "k4"])


def panel(spark, d) -> DataFrame:
    rows = cut(daily(spark, d))  # read for the symbols, the days and the values
    return bars.fill_forward(rows, rows.select("date").distinct())


@query(rounded_sql(DAILY, "open high low close volume", "symbol date n_ticks"))
def daily_bars(spark, d):
    """A2: daily open, high, low, close and volume."""
    return rounded(daily(spark, d))


@query(rounded_sql(PANEL, "open high low close volume", "symbol date"))
def daily_panel(spark, d):
    """Every symbol on every day, filled forward."""
    return rounded(panel(spark, d))


TICKS = "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, ts, hour(ts) * 60 + minute(ts) AS m, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_id AS tick_id FROM events"


def bars_sql(minutes: int, start: int = 0, where: str = "true") -> str:
    return f"""SELECT symbol, date, bar_end, arg_min(price, (ts, tick_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, tick_id)) AS close, sum(volume) AS volume, count(*) AS n_ticks
      FROM (SELECT *, CAST({start} + {minutes} * (floor((m - {start}) / {minutes}) + 1) AS INT) AS bar_end FROM ({TICKS}) WHERE {where}) GROUP BY symbol, date, bar_end"""


@query(rounded_sql(bars_sql(5), "open high low close volume", "symbol date bar_end n_ticks"))
def bars_5min(spark, d):
    """A1: five-minute bars over the whole day."""
    return rounded(bars.intraday_bars(market.ticks(spark, d), 5))


def calendar_sql() -> str:
    days = [x for x in _days() if cal.is_trading_day(x)]
    return f"SELECT * FROM (VALUES {', '.join(f'''(DATE '{x}', {cal.session_end(x)})''' for x in days)}) AS c(date, session_end)"


def _days():
    from datetime import date, timedelta

    return [date(2024, 1, 1) + timedelta(days=k) for k in range(31)]


JANUARY = calendar_sql()
REGULAR = f"SELECT t.*, session_end FROM ({TICKS}) t JOIN ({JANUARY}) c ON t.date = c.date WHERE m >= 570 AND m < session_end"


def january(spark) -> DataFrame:
    """The calendar of the month that the events cover."""
    return cal.calendar(spark).where("date BETWEEN DATE'2024-01-01' AND DATE'2024-01-31'")


@query(rounded_sql(f"SELECT symbol, ts, tick_id, price, volume FROM ({REGULAR})", "price volume", "symbol ts tick_id"))
def regular_hours(spark, d):
    """Ticks within the sessions of trading days."""
    return rounded(quality.regular_hours(market.ticks(spark, d), cal.calendar(spark)).select("symbol", "ts", "tick_id", "price", "volume"))


@query(rounded_sql(bars_sql(5, 570).replace(f"({TICKS}) WHERE true", f"({REGULAR})"), "open high low close volume", "symbol date bar_end n_ticks"))
def bars_5min_regular(spark, d):
    """A1 with S1's filter: five-minute bars of the regular session."""
    return rounded(bars.intraday_bars(quality.regular_hours(market.ticks(spark, d), cal.calendar(spark)), 5, 570))


@query(f"""
WITH c AS ({JANUARY}), s AS (SELECT DISTINCT event_type AS symbol FROM events), n AS (SELECT symbol, date, count(*) AS bars, count(*) FILTER (volume = 0) AS stale FROM ({TICKS}) GROUP BY symbol, date),
g AS (SELECT s.symbol, c.date, c.session_end, coalesce(n.bars, 0) AS bars FROM s CROSS JOIN c LEFT JOIN n ON n.symbol = s.symbol AND n.date = c.date),
r AS (SELECT *, sum(CASE WHEN bars > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS run FROM g),
x AS (SELECT symbol, max(k) AS k FROM (SELECT symbol, run, count(*) AS k FROM r WHERE bars = 0 GROUP BY symbol, run) GROUP BY symbol)
SELECT r.symbol, count(*) AS total_sessions, count(*) FILTER (bars >= session_end - 570) AS full_bar_sessions, count(*) FILTER (bars > 0 AND bars < session_end - 570) AS partial_sessions,
  count(*) FILTER (bars = 0) AS zero_bar_sessions, CAST((SELECT sum(stale) FROM n WHERE n.symbol = r.symbol) AS BIGINT) AS stale_bar_count, coalesce(max(x.k), 0) AS max_consecutive_gaps,
  round(count(*) FILTER (bars = 0) / count(*) * 100, 4) AS gap_rate_pct, round(count(*) FILTER (bars = 0) / count(*) * 100, 4) > 1.0 AS has_warning
FROM r LEFT JOIN x ON r.symbol = x.symbol GROUP BY r.symbol""")
def session_quality(spark, d):
    """Sessions, gaps and stale rows by symbol."""
    return quality.session_quality(market.ticks(spark, d), january(spark))


@query(f"SELECT date, session_end FROM ({JANUARY})")
def trading_calendar(spark, d):
    """Trading days of a month with their session ends."""
    return january(spark)


# ---------------------------------------------------------------- intraday features

M30 = bars_sql(30)
FEATURES = f"""SELECT *, minutes_raw AS minutes FROM (SELECT *, CASE WHEN cum_volume > 0 THEN turnover / cum_volume END AS vwap FROM (
  SELECT *, sum((high + low + close) / 3.0e0 * volume) OVER w AS turnover, sum(volume) OVER w AS cum_volume,
    CAST(bar_end - min(bar_end) OVER (PARTITION BY symbol, date) + 30 AS INT) AS minutes_raw, row_number() OVER w - 1 AS idx
  FROM ({M30}) WINDOW w AS (PARTITION BY symbol, date ORDER BY bar_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def half_hour(spark, d) -> tuple[DataFrame, DataFrame]:
    b = bars.intraday_bars(market.ticks(spark, d), 30)
    return b, intraday.session_features(b, 30, [90, 180])


@query(rounded_sql(f"SELECT symbol, date, bar_end, minutes, cum_volume, vwap, lag(vwap) OVER (PARTITION BY symbol, date ORDER BY bar_end) AS prev_vwap FROM ({FEATURES})", "cum_volume vwap prev_vwap", "symbol date bar_end minutes"))
def session_vwap(spark, d):
    """Session VWAP, the bar before's, cumulative volume and minutes since the open."""
    return rounded(half_hour(spark, d)[1].select("symbol", "date", "bar_end", "minutes", "cum_volume", "vwap", "prev_vwap"))


@query(rounded_sql(f"SELECT symbol, date, bar_end, max(high) FILTER (minutes <= 90) OVER w AS or_high_90, min(low) FILTER (minutes <= 90) OVER w AS or_low_90 FROM ({FEATURES}) WINDOW w AS (PARTITION BY symbol, date)", "or_high_90 or_low_90", "symbol date bar_end"))
def opening_range(spark, d):
    """High and low of the session's first bars."""
    return rounded(half_hour(spark, d)[1].select("symbol", "date", "bar_end", "or_high_90", "or_low_90"))


@query(rounded_sql(f"""SELECT symbol, date, bar_end, CASE WHEN n >= 10 AND med > 0 THEN cum_volume / med END AS rvol FROM (SELECT *, count(cum_volume) OVER w AS n, quantile_cont(cum_volume, 0.5) OVER w AS med FROM ({FEATURES})
  WINDOW w AS (PARTITION BY symbol, minutes ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""", "rvol", "symbol date bar_end"))
def relative_volume(spark, d):
    """Cumulative volume against the median of earlier sessions at that minute."""
    return rounded(intraday.relative_volume(half_hour(spark, d)[1]).select("symbol", "date", "bar_end", "rvol"))


TRUE_RANGE = f"""SELECT symbol, date, greatest(high - low, abs(high - c), abs(low - c)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c FROM (
  SELECT symbol, date, max(high) AS high, min(low) AS low, arg_max(close, bar_end) AS close FROM ({M30}) GROUP BY symbol, date HAVING max(high) > min(low)))"""


@query(rounded_sql(TRUE_RANGE, "tr", "symbol date"))
def true_range(spark, d):
    """Daily true range of sessions with a range."""
    return rounded(intraday.true_range(half_hour(spark, d)[0]))


@query(rounded_sql(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM ({TRUE_RANGE})),
  a AS (SELECT symbol, max(date) AS date, 14 AS n, sum(tr) / 14 AS atr FROM t WHERE n <= 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL
    SELECT t.symbol, t.date, a.n + 1, (a.atr * 13 + t.tr) / 14 FROM a JOIN t ON t.symbol = a.symbol AND t.n = a.n + 1) SELECT symbol, date, atr FROM a""", "atr", "symbol date"))
def wilder_atr(spark, d):
    """Wilder's average true range over 14 sessions."""
    return rounded(intraday.wilder_atr(intraday.true_range(half_hour(spark, d)[0])))


SCALED = lifecycle.GRID | {"opening_range_minutes": (90, 180), "max_hold_minutes": (360, 720), "signal_cutoff_minutes": (360, 540)}


def grid_sql(values: dict[str, tuple]) -> str:
    """Every combination of the values, with the id from its canonical JSON; no part of it comes from lifecycle."""
    lists = ", ".join(f"({', '.join(f'({json.dumps(v)})' for v in vs)}) AS {k}_({k})" for k, vs in values.items()).replace("((", "(VALUES (")
    text = " || ', ' || ".join(f"""'"{k}": ' || CAST({k} AS VARCHAR)""" for k in sorted(values))
    cast = ", ".join(f"CAST({k} AS {'BOOLEAN' if isinstance(vs[0], bool) else 'INT' if isinstance(vs[0], int) else 'DOUBLE'}) AS {k}" for k, vs in values.items())
    return f"SELECT 'c' || left(sha256('{{' || {text} || '}}'), 12) AS candidate_id, * FROM (SELECT {cast} FROM {lists})"


RVOL = f"""SELECT *, CASE WHEN n >= 10 AND med > 0 THEN cum_volume / med END AS rvol FROM (SELECT *, count(cum_volume) OVER w AS n, quantile_cont(cum_volume, 0.5) OVER w AS med FROM ({FEATURES})
  WINDOW w AS (PARTITION BY symbol, minutes ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
SIGNAL_ROWS = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM ({TRUE_RANGE})),
  a AS (SELECT symbol, max(date) AS date, 14 AS n, sum(tr) / 14 AS atr FROM t WHERE n <= 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL
    SELECT t.symbol, t.date, a.n + 1, (a.atr * 13 + t.tr) / 14 FROM a JOIN t ON t.symbol = a.symbol AND t.n = a.n + 1),
  days AS (SELECT d.symbol, d.date, last_value(a.atr IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS atr
    FROM (SELECT DISTINCT symbol, date FROM ({M30})) d LEFT JOIN a ON a.symbol = d.symbol AND a.date = d.date),
  x AS (SELECT f.*, lag(vwap) OVER (PARTITION BY f.symbol, f.date ORDER BY bar_end) AS prev_vwap, days.atr FROM ({RVOL}) f JOIN days ON days.symbol = f.symbol AND days.date = f.date),
  ranges AS (SELECT symbol, date, w, max(high) AS or_high, min(low) AS or_low FROM x CROSS JOIN (VALUES (90), (180)) AS r(w) WHERE minutes <= w GROUP BY symbol, date, w),
  found AS (SELECT candidate_id, x.symbol, x.date, x.bar_end, idx, close, rvol, vwap, atr, target_r, max_hold_minutes, least(stop_atr_fraction * atr, stop_range_fraction * (or_high - or_low)) AS dist FROM x JOIN ranges r ON r.symbol = x.symbol AND r.date = x.date JOIN ({grid_sql(SCALED)}) c ON c.opening_range_minutes = r.w
  WHERE atr IS NOT NULL AND close >= vwap AND minutes > c.opening_range_minutes AND minutes <= c.signal_cutoff_minutes AND rvol >= c.min_relative_volume AND or_high > or_low AND close > or_high + c.breakout_atr_buffer * atr
    AND CASE WHEN high <= low THEN 1 ELSE (close - low) / nullif(high - low, 0) END >= c.min_breakout_close_location AND (NOT c.require_rising_vwap OR coalesce(vwap > prev_vwap, false)))"""
# One step of the recursion is one bar of every session and candidate: fill, then exit, then a new signal.
RUN = f"""{SIGNAL_ROWS}, own AS (SELECT candidate_id, symbol, date, any_value(target_r) AS target_r, any_value(max_hold_minutes) AS hold, any_value(dist) AS dist, list(idx) AS marks FROM found GROUP BY candidate_id, symbol, date),
  bars AS (SELECT symbol, date, idx, bar_end, open, high, low, close, max(idx) OVER (PARTITION BY symbol, date) AS last FROM x),
  run AS (SELECT candidate_id, symbol, date, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS signal_idx, CAST(NULL AS INT) AS entry_time, CAST(NULL AS DOUBLE) AS entry_price,
      CAST(NULL AS INT) AS exit_time, CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS VARCHAR) AS exit_reason, dist, target_r, hold, marks FROM own
    UNION ALL SELECT candidate_id, symbol, date, idx, CASE WHEN (signal_idx IS NULL OR why IS NOT NULL) AND list_contains(marks, idx) THEN idx END, signal_idx, entry_time, entry_price, bar_end,
      CASE why WHEN 'stop' THEN least(open, entry_price - dist) WHEN 'target' THEN greatest(open, entry_price + target_r * dist) ELSE close END, why, dist, target_r, hold, marks
    FROM (SELECT *, CASE WHEN signal_idx IS NULL THEN NULL WHEN low <= entry_price - dist THEN 'stop' WHEN high >= entry_price + target_r * dist THEN 'target' WHEN bar_end - entry_time >= hold THEN 'max_hold' WHEN idx = last THEN 'session_close' END AS why
      FROM (SELECT r.candidate_id, b.*, r.dist, r.target_r, r.hold, r.marks, coalesce(r.pending IS NOT NULL AND r.dist > 0 AND b.open > 0 AND b.open <= 10000, false) AS fill, CASE WHEN fill THEN r.pending WHEN r.exit_reason IS NULL THEN r.signal_idx END AS signal_idx,
        CASE WHEN fill THEN b.bar_end - 30 ELSE r.entry_time END AS entry_time, CASE WHEN fill THEN b.open ELSE r.entry_price END AS entry_price FROM run r JOIN bars b ON b.symbol = r.symbol AND b.date = r.date AND b.idx = r.idx + 1)))
  SELECT candidate_id, symbol, date, signal_idx, entry_time, entry_price, entry_price - dist AS stop_price, entry_price + target_r * dist AS target_price, exit_time, exit_price, exit_reason, q AS quantity,
    (exit_price - entry_price) * q AS gross_pnl, entry_price * q AS entry_notional, exit_price * q AS exit_notional FROM (SELECT *, CAST(floor(10000 / entry_price) AS BIGINT) AS q FROM run WHERE exit_reason IS NOT NULL)"""


def signal_rows(spark, d):
    b, f = half_hour(spark, d)
    f = intraday.with_atr(intraday.relative_volume(f), b)
    return f, lifecycle.signals(f, lifecycle.candidates(spark, SCALED), [90, 180])


@query(rounded_sql(f"{SIGNAL_ROWS} SELECT * FROM found", "close rvol vwap atr", "candidate_id symbol date bar_end"))
def breakout_signals(spark, d):
    """Bars and candidates that meet the entry conditions."""
    return rounded(signal_rows(spark, d)[1].select("candidate_id", "symbol", "date", "bar_end", "close", "rvol", "vwap", "atr"))


@query(rounded_sql(RUN, "entry_price stop_price target_price exit_price gross_pnl entry_notional exit_notional", "candidate_id symbol date signal_idx entry_time exit_time exit_reason quantity"))
def breakout_trades(spark, d):
    """The trade log of all candidates."""
    return rounded(lifecycle.trades(*signal_rows(spark, d), 30))


@query(grid_sql(lifecycle.GRID))
def candidate_grid(spark, d):
    """The frozen grid with candidate ids."""
    return lifecycle.candidates(spark)


# ---------------------------------------------------------------- series functions and factors

def _series() -> tuple[Columns, dict[str, str]]:
    c = Columns(SERIES_BASE)
    s = Series(c)
    ret = s.ratio(s.delta("close", 1), s.delay("close", 1))
    return c, {
        "delay": s.delay("close", 3), "delta": s.delta("close", 3), "ts_sum": s.total("volume", 5), "ts_mean": s.mean("close", 5), "ts_std": s.std(ret, 5), "ts_min": s.low("low", 5), "ts_max": s.high("high", 5),
        "ts_argmax": s.arg_high("close", 5), "ts_argmin": s.arg_low("close", 5), "ts_rank": s.ts_rank("close", 5), "ts_corr": s.corr("close", "volume", 10), "ts_cov": s.cov("close", "volume", 10), "decay_linear": s.decay("close", 5),
        "cs_rank": s.rank("close"), "cs_rank01": s.rank01("close"), "cs_scale": s.scale(ret), "sign": s.sign(ret), "log": s.log("volume"), "signed_power": s.signed_power(ret, 2), "vwap": s.row("(open + high + low + close) / 4"), "returns": ret,
    }


SERIES_PLAN, SERIES = _series()


def _series_query(name: str, column: str):
    digits = 2 if name == "ts_cov" else 6  # products of prices and volumes are large

    def run(spark, d):
        out = SERIES_PLAN.apply(panel(spark, d), [column])
        return rounded(out.select("symbol", "date", F.col(column).cast("double").alias("value")), digits)

    run.__name__, run.__doc__ = f"series_{name}", f"The function {name} on the daily panel."
    query(rounded_sql(f"SELECT symbol, date, CAST({column} AS DOUBLE) AS value FROM ({SERIES_PLAN.sql(PANEL, [column])})", "value", "symbol date", digits))(run)


for _n, _c in SERIES.items():
    _series_query(_n, _c)


def _factor_query(name: str):
    def run(spark, d):
        return rounded(factors(panel(spark, d), [name]), 5)

    run.__name__, run.__doc__ = name, f"The factor {name} on the daily panel."
    query(rounded_sql(factors_sql(PANEL, [name], 12), name, "symbol date", 5))(run)


for _n in sorted(FACTORS):
    _factor_query(_n)

# ---------------------------------------------------------------- information coefficients

HORIZONS = [1, 5, 20]


def _ahead() -> tuple[Columns, dict[int, str]]:
    """The plan of the ranks of forward returns."""
    cols = Columns(SERIES_BASE)
    s = Series(cols)
    forward = {h: s.ratio(s.row(f"{s.lead('close', h)} - close"), "close") for h in HORIZONS}
    return cols, {h: s.rank01(x) for h, x in forward.items()}


AHEAD_PLAN, AHEAD = _ahead()
#: Factors of one plan. Its windows each write all of its columns, so a plan of all factors costs their number squared.
TOGETHER = 7


def ic_series(spark, d) -> DataFrame:
    """Rank IC of all factors. The panel and the ranks of its returns are written once and read by every plan."""
    ranks = [F.col(x).alias(f"ahead_{h}") for h, x in AHEAD.items()]
    p = cut(AHEAD_PLAN.apply(panel(spark, d), list(AHEAD.values())).select(*SERIES_BASE, *ranks))
    returns = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ahead_{h}").alias("b")) for h in HORIZONS))
    names, rows = sorted(FACTORS), []
    for k in range(0, len(names), TOGETHER):
        some = names[k : k + TOGETHER]
        values = F.array(*(F.struct(F.lit(n).alias("factor"), F.col(FACTORS[n]).cast("double").alias("value")) for n in some))
        rows.append(PLAN.apply(p, [FACTORS[n] for n in some]).select("symbol", "date", values.alias("factors"), returns.alias("returns")))
    return ic.rank_ic_of(reduce(DataFrame.unionAll, rows))


def _ic_sql() -> str:
    found = dict(sorted(FACTORS.items()))
    ahead = f"SELECT {', '.join(SERIES_BASE)}, {', '.join(f'{x} AS ahead_{h}' for h, x in AHEAD.items())} FROM ({AHEAD_PLAN.sql(PANEL, list(AHEAD.values()))})"
    wide = PLAN.sql(ahead, list(found.values()))
    names = ", ".join(f"'{n}'" for n in found)
    values = ", ".join(f"CAST({x} AS DOUBLE)" for x in found.values())
    pairs = " UNION ALL ".join(f"SELECT factor, {h} AS horizon, date, a, ahead_{h} AS b FROM r" for h in HORIZONS)
    return f"""WITH l AS (SELECT symbol, date, {', '.join(f'ahead_{h}' for h in HORIZONS)}, unnest([{names}]) AS factor, round(unnest([{values}]), 10) AS value FROM ({wide})),
      k AS (SELECT *, count(value) OVER (PARTITION BY factor, date) AS n, row_number() OVER (PARTITION BY factor, date ORDER BY value ASC NULLS LAST, symbol) AS k FROM l),
      r AS (SELECT *, CASE WHEN value IS NOT NULL AND n >= 2 THEN CAST(k - 1 AS DOUBLE) / (n - 1) END AS a FROM k),
      p AS ({pairs})
      SELECT factor, horizon, date, CASE WHEN (n - 1) * sa * sb > 1e-12 THEN cov / (sa * sb) ELSE 0.0e0 END AS ic
      FROM (SELECT factor, horizon, date, count(*) AS n, covar_samp(a, b) AS cov, stddev_samp(a) AS sa, stddev_samp(b) AS sb
        FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY factor, horizon, date) WHERE n >= 2"""


IC_SQL = _ic_sql()


def p_sql(t: str) -> str:
    poly = f"{ic.ERFC[-1]!r}e0"
    for c in ic.ERFC[-2::-1]:
        poly = f"({c!r}e0 + u * {poly})"
    return f"(SELECT least(1.0e0, u * exp(-z * z + {poly})) FROM (SELECT abs({t}) / sqrt(2.0e0) AS z, 1 / (1 + 0.5e0 * abs({t}) / sqrt(2.0e0)) AS u))"


def summary_sql(source: str) -> str:
    return f"SELECT *, {p_sql('t_stat')} AS p_value FROM (SELECT *, mean_ic / nullif(std_ic, 0) AS ic_ir, mean_ic / nullif(std_ic, 0) * sqrt(n_obs) AS t_stat FROM (SELECT factor, horizon, count(*) AS n_obs, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic FROM ({source}) GROUP BY factor, horizon))"


KEYS = ["factor", "horizon"]


@query(rounded_sql(IC_SQL, "ic", "factor horizon date"))
def rank_ic(spark, d):
    """Rank IC of every factor against forward returns at every horizon."""
    return rounded(ic_series(spark, d))


@query(rounded_sql(summary_sql(IC_SQL), "mean_ic std_ic ic_ir t_stat p_value", "factor horizon n_obs"))
def ic_summary(spark, d):
    """Summary of each IC series."""
    return rounded(ic.summary(ic_series(spark, d), KEYS))


@query(rounded_sql(summary_sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor, horizon ORDER BY date) - 1 AS k FROM ({IC_SQL})) WHERE k % horizon = 0"), "mean_ic std_ic ic_ir t_stat p_value", "factor horizon n_obs"))
def ic_summary_nonoverlap(spark, d):
    """Summary of values that don't overlap, every h-th at horizon h."""
    return rounded(ic.summary(ic.every(ic_series(spark, d), KEYS, F.col("horizon")), KEYS))


_LAGS = " + ".join(f"CASE WHEN {k} < horizon THEN 2 * (1 - {k} / CAST(horizon AS DOUBLE)) * coalesce(sum(u * u{k}), 0) ELSE 0 END" for k in range(1, max(HORIZONS)))


@query(rounded_sql(f"""SELECT *, {p_sql('hac_t_stat')} AS hac_p_value FROM (SELECT factor, horizon, n_obs, mean_ic, CASE WHEN w > 0 THEN mean_ic * sqrt(n_obs) / sqrt(w / (n_obs - 1)) END AS hac_t_stat FROM (
  SELECT factor, horizon, count(*) AS n_obs, avg(ic) AS mean_ic, sum(u * u) + {_LAGS} AS w FROM (SELECT *, {', '.join(f'lag(u, {k}) OVER o AS u{k}' for k in range(1, max(HORIZONS)))} FROM (
    SELECT *, ic - avg(ic) OVER (PARTITION BY factor, horizon) AS u FROM ({IC_SQL})) WINDOW o AS (PARTITION BY factor, horizon ORDER BY date)) GROUP BY factor, horizon))""", "mean_ic hac_t_stat hac_p_value", "factor horizon n_obs"))
def ic_summary_hac(spark, d):
    """Newey-West statistics, h - 1 lags at horizon h."""
    return rounded(ic.hac(ic_series(spark, d), KEYS, F.col("horizon") - 1, max(HORIZONS) - 1))


@query(rounded_sql(f"""SELECT factor, horizon, p_value, least(1.0e0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS bh_p, least(1.0e0, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS rejected
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, factor, horizon) AS k, count(*) OVER () AS m FROM ({summary_sql(IC_SQL)}))""", "p_value bh_p", "factor horizon rejected"))
def false_discovery(spark, d):
    """Benjamini-Hochberg over all factors and horizons, 126 hypotheses."""
    found = ic.discoveries(ic.summary(ic_series(spark, d), KEYS), KEYS)
    return rounded(found.select(*KEYS, "p_value", "bh_p", "rejected"))


# ---------------------------------------------------------------- trades, walk-forward, monitoring

PSEUDO = """SELECT l_suppkey AS candidate, p_brand AS symbol, CAST(l_shipdate AS DATE) AS exit_date, l_extendedprice * (l_discount - l_tax) AS gross_pnl, l_extendedprice AS entry_notional,
  l_extendedprice + l_extendedprice * (l_discount - l_tax) AS exit_notional FROM lineitem JOIN part ON l_partkey = p_partkey"""
COSTED = f"SELECT *, gross_pnl - (entry_notional + exit_notional) * bps / 10000.0e0 AS net FROM ({PSEUDO}) CROSS JOIN (VALUES ('zero', 0.0e0), ('baseline', 2.5e0), ('double', 5.0e0)) AS s(scenario, bps)"
AGG = """count(*) AS trades, avg(CASE WHEN net > 0 THEN 1.0e0 ELSE 0.0e0 END) AS win_rate, coalesce(sum(net) FILTER (net > 0), 0) / sum(-net) FILTER (net < 0) AS profit_factor,
  avg(net / nullif(entry_notional, 0) * 10000) AS mean_net_bps, sum(net) AS total_net_pnl"""


@query(rounded_sql(f"SELECT candidate, scenario, {AGG} FROM ({COSTED}) GROUP BY candidate, scenario", "win_rate profit_factor mean_net_bps total_net_pnl", "candidate scenario trades", 4))
def trade_metrics(spark, d):
    """Metrics of each candidate under each cost."""
    return rounded(metrics.trade_metrics(metrics.with_costs(market.pseudo_trades(spark, d)), ["candidate", "scenario"]), 4)


RETURNS = f"""SELECT c.candidate, n.date, coalesce(r.ret, 0) AS ret FROM (SELECT DISTINCT candidate FROM ({PSEUDO})) c CROSS JOIN (SELECT DISTINCT exit_date AS date FROM ({PSEUDO})) n
  LEFT JOIN (SELECT candidate, exit_date, sum(net) / 100000.0e0 AS ret FROM ({COSTED}) WHERE scenario = 'baseline' GROUP BY candidate, exit_date) r ON r.candidate = c.candidate AND r.exit_date = n.date"""


def candidate_returns(spark, d) -> DataFrame:
    t = market.pseudo_trades(spark, d).withColumn("net", metrics.net(2.5))
    return metrics.daily_returns(t, ["candidate"], t.select(F.col("exit_date").alias("date")).distinct())


@query(rounded_sql(RETURNS, "ret", "candidate date"))
def daily_returns(spark, d):
    """Daily return series of each candidate."""
    return rounded(candidate_returns(spark, d))


@query(rounded_sql(f"""SELECT candidate, count(*) AS days, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252.0e0) AS sharpe, max(greatest(0, peak) - equity) AS max_drawdown FROM (SELECT *, max(equity) OVER w AS peak FROM (
  SELECT *, sum(ret) OVER (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM ({RETURNS})) WINDOW w AS (PARTITION BY candidate ORDER BY date ROWS UNBOUNDED PRECEDING)) GROUP BY candidate""", "sharpe max_drawdown", "candidate days"))
def return_metrics(spark, d):
    """Sharpe ratio and drawdown of each candidate."""
    cells = cut(metrics.daily_cells(market.pseudo_trades(spark, d).withColumn("net", metrics.net(2.5)), ["candidate"]))
    days = cells.agg(F.countDistinct("date").alias("days"))
    return rounded(metrics.cell_metrics(cells, ["candidate"], days).select("candidate", "days", "sharpe", "max_drawdown"))


@query(rounded_sql(f"SELECT symbol, sum(net) AS net FROM ({COSTED}) WHERE scenario = 'baseline' GROUP BY symbol", "net", "symbol", 3))
def symbol_attribution(spark, d):
    """Net profit by symbol."""
    return rounded(metrics.attribution(market.pseudo_trades(spark, d).withColumn("net", metrics.net(2.5))), 3)


DAYS = f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT exit_date AS date FROM ({PSEUDO}))"
FOLDS = f"""SELECT CAST(fold AS INT) AS fold, CASE WHEN n - fold * 63 < 201 THEN 'train' WHEN n - fold * 63 < 252 THEN 'validation' ELSE 'test' END AS part, date
  FROM ({DAYS}) CROSS JOIN (SELECT unnest(range(0, 1000)) AS fold) WHERE n >= fold * 63 AND n < fold * 63 + 315 AND fold * 63 + 315 <= (SELECT count(*) FROM ({DAYS}))"""
FOUND = f"""WITH f AS ({FOLDS}), t AS (SELECT * FROM ({COSTED}) WHERE scenario = 'baseline'), o AS (SELECT fold, part, t.* FROM t JOIN f ON t.exit_date = f.date),
  m AS (SELECT fold, part, candidate, {AGG} FROM o GROUP BY fold, part, candidate),
  r AS (SELECT c.fold, c.part, c.candidate, f.date, coalesce(s.ret, 0) AS ret FROM (SELECT DISTINCT fold, part, candidate FROM o) c JOIN f ON f.fold = c.fold AND f.part = c.part
    LEFT JOIN (SELECT fold, part, candidate, exit_date, sum(net) / 100000.0e0 AS ret FROM o GROUP BY ALL) s ON s.fold = c.fold AND s.part = c.part AND s.candidate = c.candidate AND s.exit_date = f.date),
  h AS (SELECT fold, part, candidate, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252.0e0) AS sharpe FROM r GROUP BY fold, part, candidate),
  x AS (SELECT m.*, h.sharpe FROM m JOIN h ON h.fold = m.fold AND h.part = m.part AND h.candidate = m.candidate),
  g AS (SELECT t.fold, t.candidate, CASE WHEN t.trades < 30 THEN 'min_trades' WHEN NOT coalesce(t.sharpe >= 0, false) THEN 'train_sharpe' WHEN NOT coalesce(t.profit_factor >= 1, true) THEN 'train_pf'
    WHEN NOT coalesce(v.total_net_pnl > 0, false) THEN 'val_pnl' END AS gate, v.sharpe AS val_sharpe FROM (SELECT * FROM x WHERE part = 'train') t LEFT JOIN (SELECT * FROM x WHERE part = 'validation') v ON v.fold = t.fold AND v.candidate = t.candidate)"""
CHOSEN = "SELECT fold, candidate, val_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(val_sharpe, 9) DESC, candidate) AS k FROM g WHERE gate IS NULL AND val_sharpe IS NOT NULL) WHERE k = 1"


def _cells(spark, d) -> tuple[DataFrame, DataFrame]:
    """Daily cells, written once, and the days of each fold."""
    cells = cut(walkforward.costed_cells(market.pseudo_trades(spark, d)))
    return cells, walkforward.folds(walkforward.day_numbers(cells, "date"))


def _gates(spark, d):
    found = walkforward.fold_metrics(*_cells(spark, d))
    return found, walkforward.gated(found)


@query(f"SELECT fold, part, date FROM ({FOLDS})")
def fold_days(spark, d):
    """The days of each fold."""
    return walkforward.folds(walkforward.day_numbers(market.pseudo_trades(spark, d)))


@query(f"{FOUND} SELECT fold, candidate, gate, round(val_sharpe + {off(6):.4e}, 6) + 0.0e0 AS val_sharpe FROM g")
def fold_gates(spark, d):
    """The first gate each candidate fails in each fold."""
    return rounded(_gates(spark, d)[1])


@query(f"{FOUND} SELECT fold, gate, count(*) AS n FROM g WHERE gate IS NOT NULL GROUP BY fold, gate")
def fold_rejections(spark, d):
    """A10: rejections by gate."""
    return walkforward.rejections(_gates(spark, d)[1])


@query(f"{FOUND} SELECT fold, candidate, round(val_sharpe + {off(6):.4e}, 6) + 0.0e0 AS val_sharpe FROM ({CHOSEN})")
def fold_selection(spark, d):
    """The chosen candidate of each fold."""
    return rounded(walkforward.selected(_gates(spark, d)[1]))


@query(f"{FOUND} SELECT x.fold, x.candidate, trades, round(total_net_pnl, 3) + 0.0e0 AS total_net_pnl, round(sharpe, 6) + 0.0e0 AS sharpe FROM x JOIN ({CHOSEN}) c ON c.fold = x.fold AND c.candidate = x.candidate WHERE part = 'test'")
def outer_test(spark, d):
    """Metrics of the chosen candidates on the test days."""
    found, gates = _gates(spark, d)
    test = found.where("part = 'test'").join(walkforward.selected(gates).select("fold", "candidate"), ["fold", "candidate"])
    return test.select("fold", "candidate", "trades", (F.round("total_net_pnl", 3) + F.lit(0.0)).alias("total_net_pnl"), (F.round("sharpe", 6) + F.lit(0.0)).alias("sharpe"))


OUTER = f"""{FOUND}, z AS (SELECT s.* FROM ({COSTED}) s JOIN f ON s.exit_date = f.date AND f.part = 'test' JOIN ({CHOSEN}) c ON c.fold = f.fold AND c.candidate = s.candidate),
  days AS (SELECT DISTINCT date FROM f WHERE part = 'test'),
  e AS (SELECT scenario, date, sum(ret) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity, ret FROM (
    SELECT k.scenario, days.date, coalesce(r.ret, 0) AS ret FROM (SELECT DISTINCT scenario FROM z) k CROSS JOIN days LEFT JOIN (SELECT scenario, exit_date, sum(net) / 100000.0e0 AS ret FROM z GROUP BY scenario, exit_date) r
      ON r.scenario = k.scenario AND r.exit_date = days.date)),
  v AS (SELECT scenario, count(*) AS days, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252.0e0) AS sharpe, max(greatest(0, peak) - equity) AS max_drawdown FROM (
    SELECT *, max(equity) OVER (PARTITION BY scenario ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM e) GROUP BY scenario),
  y AS (SELECT v.*, w.* EXCLUDE (scenario) FROM v JOIN (SELECT scenario, {AGG} FROM z GROUP BY scenario) w ON w.scenario = v.scenario)
  SELECT scenario, trades, days, concat_ws(',', CASE WHEN trades >= 100 THEN NULL ELSE 'trades' END, CASE WHEN sharpe > 0.5e0 THEN NULL ELSE 'sharpe' END, CASE WHEN mean_net_bps > 0 THEN NULL ELSE 'mean_net_bps' END,
    CASE WHEN profit_factor < 1.1e0 THEN 'profit_factor' END) AS failed, {', '.join(f'round({c} + {off(4):.4e}, 4) + 0.0e0 AS {c}' for c in ('win_rate', 'profit_factor', 'mean_net_bps', 'total_net_pnl', 'sharpe', 'max_drawdown'))} FROM y"""


@query(OUTER)
def outer_decision(spark, d):
    """The chosen candidates over all test days under each cost, and the final gates they fail."""
    cells, parts = _cells(spark, d)
    chosen = walkforward.selected(walkforward.gated(walkforward.fold_metrics(cells, parts)))
    out = walkforward.decided(walkforward.outer(cells, parts, chosen))
    return rounded(out.select("scenario", "trades", "days", "failed", "win_rate", "profit_factor", "mean_net_bps", "total_net_pnl", "sharpe", "max_drawdown"), 4)


@query(f"""{FOUND} SELECT symbol, round(sum(net), 3) + 0.0e0 AS net FROM ({COSTED}) s JOIN f ON s.exit_date = f.date AND f.part = 'test' JOIN ({CHOSEN}) c ON c.fold = f.fold AND c.candidate = s.candidate
  WHERE scenario = 'baseline' GROUP BY symbol""")
def outer_attribution(spark, d):
    """Net profit by symbol of the chosen candidates' test trades."""
    cells, parts = _cells(spark, d)
    chosen = walkforward.selected(walkforward.gated(walkforward.fold_metrics(cells, parts)))
    return walkforward.outer_attribution(market.pseudo_trades(spark, d), parts, chosen).select("symbol", (F.round("net", 3) + F.lit(0.0)).alias("net"))


@query(f"SELECT count(*) AS trade_count, min(exit_date) AS start, max(exit_date) AS \"end\" FROM ({PSEUDO})")
def run_totals(spark, d):
    """Totals of a run."""
    return walkforward.totals(market.pseudo_trades(spark, d))


@query(f"""WITH d AS ({DAYS}), t AS (SELECT count(*) AS total FROM d), b AS (SELECT date, n, CAST(least(floor(n / floor(total / 6)), 5) AS INT) AS block FROM d CROSS JOIN t WHERE total >= 7),
  s AS (SELECT block AS split, min(date) AS start FROM b WHERE block > 0 GROUP BY block)
  SELECT split, CASE WHEN block = split THEN 'validation' ELSE 'train' END AS part, date FROM b JOIN s ON block = split OR (block < split AND date < start - INTERVAL 25 DAY)""")
def purged_splits(spark, d):
    """Time-ordered splits with a gap before validation."""
    return walkforward.purged_splits(walkforward.day_numbers(market.pseudo_trades(spark, d)))


def unpivoted_sql(source: str, keys: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {source}" for n in names)


PAIRED = f"""{FOUND}, q AS ({unpivoted_sql('x', 'candidate, fold, part', monitor.COMPARED)}),
  d AS (SELECT a.candidate, a.metric, b.value - a.value AS d FROM q a JOIN q b ON a.candidate = b.candidate AND a.metric = b.metric AND a.fold = b.fold
    WHERE a.part = 'validation' AND b.part = 'test' AND a.value IS NOT NULL AND b.value IS NOT NULL),
  e AS (SELECT candidate, metric, count(*) AS n, avg(d) AS mean_diff, avg(d) * sqrt(count(*)) / nullif(stddev_samp(d), 0) AS t_stat FROM d GROUP BY candidate, metric),
  p AS (SELECT *, {p_sql('t_stat')} AS p_value FROM e)"""


def paired(spark, d) -> DataFrame:
    found = _gates(spark, d)[0]
    v, t = (monitor.unpivoted(found.where(F.col("part") == p), ["candidate", "fold"], monitor.COMPARED) for p in ("validation", "test"))
    return monitor.paired_test(v, t, ["candidate", "metric"])


@query(f"{PAIRED} SELECT candidate, metric, n, round(mean_diff, 5) + 0.0e0 AS mean_diff, round(t_stat, 6) + 0.0e0 AS t_stat, round(p_value, 6) + 0.0e0 AS p_value FROM p")
def paired_comparison(spark, d):
    """Paired tests of five metrics over folds, validation against test."""
    return paired(spark, d).select("candidate", "metric", "n", *((F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("mean_diff", 5), ("t_stat", 6), ("p_value", 6))))


@query(f"""{PAIRED}, w AS (SELECT candidate, max(n) AS n, bool_or(metric IN ('sharpe', 'mean_net_bps') AND p_value < 0.05e0 AND mean_diff > 0) AS better,
  bool_or(metric = 'sharpe' AND p_value < 0.05e0 AND mean_diff < 0) AS worse FROM p GROUP BY candidate)
  SELECT candidate, CASE WHEN n < 2 THEN 'insufficient_data' WHEN better THEN 'significantly_better' WHEN worse THEN 'significantly_worse' ELSE 'no_significant_improvement' END AS verdict FROM w""")
def comparison_verdict(spark, d):
    """What the paired tests say of each candidate."""
    return monitor.comparison_verdict(paired(spark, d), ["candidate"])


DRIFT = f"""{FOUND}, s AS (SELECT c.fold, x.* EXCLUDE (fold) FROM ({CHOSEN}) c LEFT JOIN x ON x.fold = c.fold AND x.candidate = c.candidate AND x.part = 'test'),
  q AS ({unpivoted_sql('s', 'fold', monitor.TRACKED)}), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY fold DESC) AS k FROM q),
  e AS (SELECT metric, count(*) FILTER (k > 3) AS n_reference, avg(value) FILTER (k <= 3) AS recent_mean, avg(value) FILTER (k > 3) AS reference_mean, stddev_samp(value) FILTER (k > 3) AS sd FROM k GROUP BY metric),
  z AS (SELECT *, CASE WHEN n_reference >= 3 THEN (recent_mean - reference_mean) / nullif(sd, 0) END AS z FROM e),
  v AS (SELECT *, CASE WHEN z IS NULL THEN 'insufficient_data' WHEN z >= -1 THEN 'stable' WHEN z >= -2 THEN 'moderate' ELSE 'significant' END AS verdict FROM z)"""


def drifts(spark, d) -> DataFrame:
    found, gates = _gates(spark, d)
    test = walkforward.selected(gates).select("fold", "candidate").join(found.where("part = 'test'"), ["fold", "candidate"], "left")
    return monitor.drift(monitor.unpivoted(test, ["fold"], monitor.TRACKED), ["metric"])


@query(f"{DRIFT} SELECT metric, n_reference, round(recent_mean, 4) + 0.0e0 AS recent_mean, round(reference_mean, 4) + 0.0e0 AS reference_mean, round(z, 6) + 0.0e0 AS z, verdict FROM v")
def drift(spark, d):
    """Drift of each tracked metric over the last selected folds."""
    return drifts(spark, d).select("metric", "n_reference", *((F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("recent_mean", 4), ("reference_mean", 4), ("z", 6))), "verdict")


@query(f"""{DRIFT} SELECT CASE WHEN max(n_reference) < 3 THEN 'insufficient_data' WHEN bool_or(verdict = 'significant') THEN 'significant' WHEN bool_or(verdict = 'moderate') THEN 'moderate' ELSE 'stable' END AS verdict
  FROM v HAVING count(*) > 0""")
def drift_verdict(spark, d):
    """The worst verdict of the tracked metrics."""
    return monitor.worst(drifts(spark, d).withColumn("run", F.lit(1)), ["run"]).select("verdict")


# ---------------------------------------------------------------- universe and dedup

LISTING = "SELECT o_custkey % 40 AS instrument_id, 'S' || o_custkey AS symbol, CAST(min(o_orderdate) AS DATE) AS listed_from, CAST(max(o_orderdate) AS DATE) AS listed_to FROM orders GROUP BY o_custkey"


def listings(spark, d) -> DataFrame:
    o = market.table(spark, d, "orders")
    rows = o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("listed_from"), F.to_date(F.max("o_orderdate")).alias("listed_to"))
    return rows.select((F.col("o_custkey") % 40).alias("instrument_id"), F.concat(F.lit("S"), "o_custkey").alias("symbol"), "listed_from", "listed_to")


@query(f"SELECT instrument_id, count(*) AS n FROM (SELECT *, row_number() OVER w AS n, lag(listed_to) OVER w AS e FROM ({LISTING}) WINDOW w AS (PARTITION BY instrument_id ORDER BY listed_from, listed_to)) WHERE n > 1 AND (e IS NULL OR listed_from < e) GROUP BY instrument_id")
def listing_overlaps(spark, d):
    """Overlapping listing intervals by instrument."""
    return quality.overlaps(listings(spark, d)).groupBy("instrument_id").agg(F.count("*").alias("n"))


SHARED = LISTING.replace("'S' || o_custkey AS symbol", "'S' || o_custkey % 500 AS symbol")


@query(f"""SELECT symbol, date, count(DISTINCT instrument_id) AS n, CASE WHEN count(DISTINCT instrument_id) = 1 THEN min(instrument_id) END AS instrument_id
  FROM (SELECT DISTINCT symbol, d.date FROM ({SHARED}) CROSS JOIN (SELECT unnest([DATE '1996-01-01', DATE '1998-06-01', DATE '2000-12-31']) AS date) d) a
  LEFT JOIN (SELECT symbol AS s, instrument_id, listed_from, listed_to FROM ({SHARED})) i ON s = symbol AND listed_from <= date AND date < listed_to GROUP BY symbol, date""")
def symbol_instruments(spark, d):
    """The instrument of each symbol on a date, if it is one."""
    rows = listings(spark, d).withColumn("symbol", F.concat(F.lit("S"), F.substring("symbol", 2, 20).cast("long") % 500))
    days = spark.createDataFrame([(x,) for x in ("1996-01-01", "1998-06-01", "2000-12-31")], "date string").select(F.to_date("date").alias("date"))
    return quality.instrument_at(rows.select("symbol").distinct().crossJoin(F.broadcast(days)), rows)


@query(f"SELECT date, count(*) AS members FROM ({LISTING}) JOIN (SELECT unnest([DATE '1996-01-01', DATE '1998-06-01', DATE '2000-12-31']) AS date) ON listed_from <= date AND date < listed_to GROUP BY date")
def universe_on_dates(spark, d):
    """Members of the universe at dates."""
    days = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("date") for x in ("1996-01-01", "1998-06-01", "2000-12-31")))).alias("date"))
    return quality.listed_on(listings(spark, d), days).groupBy("date").agg(F.count("*").alias("members"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1")
def key_conflicts(spark, d):
    """2.10: keys with different rows."""
    return quality.conflicts(market.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def first_by_key(spark, d):
    """2.10: the first row of each key."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey")
    rows = market.table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k = 1")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ---------------------------------------------------------------- filter of trades

PRICED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity AS e, l_extendedprice / l_quantity * (1 - l_discount) AS s, l_extendedprice / l_quantity * (1 + l_tax) AS t,
  570 + l_partkey % 500 AS m, CASE WHEN l_extendedprice * (l_discount - l_tax) - (l_extendedprice + (l_extendedprice + l_extendedprice * (l_discount - l_tax))) * 2.5e0 / 10000.0e0 > 0 THEN 1.0e0 ELSE 0.0e0 END AS label FROM lineitem"""
FILTER_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (e - s) / e AS stop_distance, (t - e) / e AS target_distance, CASE WHEN e - s > 1e-9 THEN (t - e) / (e - s) ELSE 0.0e0 END AS reward_ratio,
  least(1.0e0, (m - 570) / 390.0e0) AS session_time, label FROM ({PRICED})"""


def priced_trades(spark, d) -> DataFrame:
    """Line items as trades with prices, features and label."""
    gross, price = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")), F.col("l_extendedprice") / F.col("l_quantity")
    rows = market.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("exit_date"), price.alias("entry_price"), (price * (1 - F.col("l_discount"))).alias("stop_price"),
        (price * (1 + F.col("l_tax"))).alias("target_price"), (570 + F.col("l_partkey") % 500).alias("entry_time"), gross.alias("gross_pnl"), F.col("l_extendedprice").alias("entry_notional"), (F.col("l_extendedprice") + gross).alias("exit_notional"),
    )
    return filtering.labelled(filtering.features(rows))


@query(rounded_sql(FILTER_SQL, "stop_distance target_distance reward_ratio session_time label", "l_orderkey l_linenumber l_partkey l_suppkey"))
def filter_features(spark, d):
    """Features and labels of trades."""
    return rounded(priced_trades(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *filtering.FEATURES, "label"))


@query(rounded_sql(f"SELECT l_suppkey AS candidate, -avg(label * ln(greatest(1e-7, least(1 - 1e-7, stop_distance * 10))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, stop_distance * 10)))) AS loss FROM ({FILTER_SQL}) GROUP BY l_suppkey", "loss", "candidate"))
def filter_log_loss(spark, d):
    """Log loss by candidate of a probability that grows with the distance of the stop."""
    scored = priced_trades(spark, d).withColumn("p", F.col("stop_distance") * 10)
    return rounded(scored.groupBy(F.col("l_suppkey").alias("candidate")).agg(filtering.log_loss("p").alias("loss")))


@query()
def filtered_trades(spark, d):
    """A classifier learns from the first four fifths of the days; of the trades after them it keeps likely wins."""
    rows = priced_trades(spark, d)
    days = walkforward.day_numbers(rows)
    edge = days.where(F.col("n") == F.lit(days.count() * 4 // 5)).first()
    if edge is None:
        return filtering.scored(rows, None)
    train = rows.where(F.col("exit_date") < F.date_sub(F.lit(edge.date), 25))
    return filtering.filtered(train, rows.where(F.col("exit_date") >= F.lit(edge.date)))


# ---------------------------------------------------------------- requests

@query("""SELECT c AS customer, CAST(m AS DATE) AS first, least(CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), b) AS last
  FROM (SELECT c, b, unnest(generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM (SELECT o_custkey AS c, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey))""")
def month_ranges(spark, d):
    """The months between each customer's first and last order, whole but for the last one."""
    span = market.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.to_date(F.min("o_orderdate")).alias("_a"), F.to_date(F.max("o_orderdate")).alias("_b"))
    return feed.month_ranges(span, F.col("_a"), F.col("_b")).select("customer", "first", "last")
