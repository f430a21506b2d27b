"""Known answers, plain-Python comparisons and the SQL of a few queries."""

from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import calendar as cal
from tidemark.functions.series import Series
from tidemark.operators import bars, ic, lifecycle, monitor, quality
from tidemark.operators.factors import FACTORS, factors
from tidemark.plans.staged import Columns
from tidemark.streaming.bars import streaming_bars

SF = "/root/testdata/sf0.001"


def test_calendar_facts():
    assert not cal.is_trading_day(date(2025, 1, 9)) and not cal.is_trading_day(date(2026, 7, 3))
    assert cal.is_trading_day(date(2021, 6, 18)) and not cal.is_trading_day(date(2022, 6, 20)) and cal.is_trading_day(date(2021, 12, 31))
    assert not cal.is_trading_day(date(2024, 3, 29)) and cal.easter(2024) == date(2024, 3, 31) and cal.easter(2025) == date(2025, 4, 20)
    assert [cal.session_end(x) for x in (date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24), date(2024, 7, 5))] == [780, 780, 780, 960]
    with pytest.raises(ValueError):
        cal.is_trading_day(date(2031, 1, 2))


def test_grid_ids():
    grid = lifecycle.grid()
    assert len(grid) == 192 and lifecycle.grid_hash(grid) == "68f21a729b407c63"
    assert {"c692bf06525d6", "cc17e39651c0d", "c78a02f455318"} <= {lifecycle.candidate_id(c) for c in grid}


def panel_rows(spark, n_days=60, n=5, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = 50 * np.cumprod(1 + 0.02 * rng.normal(size=n_days))
        for t in range(n_days):
            if t >= k and rng.random() > 0.05:
                o, h, l = c[t] * 1.001, c[t] * 1.02, c[t] * 0.98
                rows.append((f"s{k}", date(2024, 1, 1).fromordinal(date(2024, 1, 1).toordinal() + t), float(o), float(h), float(l), float(c[t]), float(rng.integers(1, 1000))))
            else:
                rows.append((f"s{k}", date(2024, 1, 1).fromordinal(date(2024, 1, 1).toordinal() + t), *(None,) * 5))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_series_against_numpy(spark):
    df = panel_rows(spark)
    c = Columns(["symbol", "date", "open", "high", "low", "close", "volume"])
    s = Series(c)
    names = {"rank": s.ts_rank("close", 5), "corr": s.corr("close", "volume", 10), "arg": s.arg_high("close", 5), "std": s.std("close", 5), "xs": s.rank("close")}
    got = c.apply(df, list(names.values())).toPandas().sort_values(["symbol", "date"])
    for _, g in got.groupby("symbol"):
        x, v = g["close"].to_numpy(float), g["volume"].to_numpy(float)
        for t in range(len(x)):
            w, y = x[max(0, t - 4) : t + 1], x[max(0, t - 9) : t + 1]
            z = v[max(0, t - 9) : t + 1]
            want = np.nan if t < 4 else float(np.argmax(w))
            assert np.array_equal(g[names["arg"]].to_numpy(float)[t], want, equal_nan=True)
            want = np.nan if t < 4 else (w <= w[-1]).sum() / 5
            assert np.allclose(g[names["rank"]].to_numpy(float)[t], want, equal_nan=True)
            want = np.nan if t < 4 else np.std(w, ddof=1)
            assert np.allclose(g[names["std"]].to_numpy(float)[t], want, equal_nan=True)
            want = np.nan if t < 9 else 0.0 if np.isnan(y + z).any() else np.corrcoef(y, z)[0, 1]
            assert np.allclose(g[names["corr"]].to_numpy(float)[t], want, equal_nan=True)


def test_factors_do_not_look_ahead(spark):
    df = panel_rows(spark, 40)
    last = df.agg(F.max("date")).first()[0]
    changed = df.withColumn("close", F.when(F.col("date") == last, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (factors(x).where(F.col("date") < F.lit(last)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for x in (df, changed))
    assert len(FACTORS) == 42 and a.equals(b)


def test_statistics(spark):
    p = [0.0004, 0.0071, 0.0122, 0.0213, 0.031, 0.17, 0.26, 0.44, 0.58]  # bounds are k / 180: 0.0056, 0.0111, ...
    tests = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "name int, p_value double")
    found = ic.discoveries(tests, ["name"]).orderBy("name").toPandas()
    assert found["rejected"].tolist() == [k < 4 for k in range(9)]
    x = np.array([0.04, 0.11, -0.07, 0.02, 0.19, -0.03])
    series = spark.createDataFrame([("f", date(2024, 1, k + 1), float(v)) for k, v in enumerate(x)], "factor string, date date, ic double")
    u = x - x.mean()
    s = (u @ u + u[1:] @ u[:-1]) / (len(x) - 1)
    got = ic.hac(series, ["factor"], 1).first()
    assert np.isclose(got.hac_t_stat, x.mean() * np.sqrt(len(x)) / np.sqrt(s))
    assert np.isclose(ic.hac(series, ["factor"], 0).first().hac_t_stat, ic.summary(series, ["factor"]).first().t_stat)


def plain_trades(b, at, c, dist, minutes):
    """The lifecycle, bar by bar."""
    out, pos, pending = [], None, None
    for i, end, o, h, l, close in b:
        if pending is not None:
            qty = int(10_000 // o) if o > 0 else 0
            if dist > 0 and qty > 0:
                pos = (pending, end - minutes, o, o - dist, o + c["target_r"] * dist, qty)
            pending = None
        price = why = None
        if pos:
            _, t, _, stop, target, _ = pos
            for cond, p, w in ((o <= stop, o, "stop"), (l <= stop, stop, "stop"), (o >= target, o, "target"), (h >= target, target, "target"), (end - t >= c["max_hold_minutes"], close, "max_hold")):
                if cond:
                    price, why = p, w
                    break
            if why:
                out.append((*pos[:3], end, price, why, pos[5]))
                pos = None
        if not pos and i in at:
            pending = i
    if pos:
        out.append((*pos[:3], b[-1][1], b[-1][5], "session_close", pos[5]))
    return out


def test_trades_against_a_loop(spark):
    features, found = catalog.signal_rows(spark, "/root/testdata/sf0.01")
    log = lifecycle.trades(features, found, 30).toPandas()
    params = {lifecycle.candidate_id(c): c for c in lifecycle.grid(catalog.SCALED)}
    bars_of = {k: sorted(zip(g["idx"], g["bar_end"], g["open"], g["high"], g["low"], g["close"], strict=True)) for k, g in features.toPandas().groupby(["symbol", "date"])}
    want = []
    for (s, d, c), g in found.toPandas().groupby(["symbol", "date", "candidate_id"]):
        r = g.iloc[0]
        dist = min(r.stop_atr_fraction * r.atr, r.stop_range_fraction * (r.or_high - r.or_low))
        want += [(c, s, d, *t) for t in plain_trades(bars_of[s, d], set(g["idx"]), params[c], dist, 30)]
    got = list(log[["candidate_id", "symbol", "date", "signal_idx", "entry_time", "entry_price", "exit_time", "exit_price", "exit_reason", "quantity"]].itertuples(index=False, name=None))
    plain = [[tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows] for rows in (want, got)]
    assert len(got) > 500 and sorted(plain[0], key=str) == sorted(plain[1], key=str)


@pytest.mark.parametrize(
    ("after", "want"),
    [
        ([(102.5, 102.7, 102.2, 102.6), (102.6, 103.6, 102.4, 103.5)], ("target", 103.4, 97)),
        ([(102.5, 102.7, 102.2, 102.6), (102.6, 103.6, 101.8, 103.5)], ("stop", 101.9, 97)),  # spans both
        ([(102.5, 102.7, 102.2, 102.6), (101.0, 101.5, 100.0, 101.2)], ("stop", 101.0, 97)),  # opens below the stop
        ([(102.5, 102.7, 102.2, 102.6)], ("session_close", 102.6, 97)),
        ([], None),  # no bar to fill at
    ],
)
def test_trades_known_answers(spark, after, want):
    """Entry 102.5; 0.6 to the stop, 0.9 to the target."""
    bars_ = [(100.0, 101.0, 99.5, 100.5), (100.5, 102.6, 100.4, 102.4), *after]
    day = date(2024, 6, 3)
    features = spark.createDataFrame([("S", day, k, 575 + 5 * k, *map(float, b)) for k, b in enumerate(bars_)], "symbol string, date date, idx int, bar_end int, open double, high double, low double, close double")
    found = spark.createDataFrame([("S", day, "c", 1, 1.5, 60, 0.6, 1.0, 0.5, 101.0, 99.0)], "symbol string, date date, candidate_id string, idx int, target_r double, max_hold_minutes int, stop_atr_fraction double, atr double, stop_range_fraction double, or_high double, or_low double")
    got = lifecycle.trades(features, found, 5).collect()
    assert [(r.exit_reason, round(r.exit_price, 9), r.quantity) for r in got] == ([want] if want else [])
    assert all(r.entry_price == 102.5 and r.entry_time == 580 for r in got)


def test_monitoring_and_universe(spark):
    v = spark.createDataFrame([("a", k, x) for k, x in enumerate([1.0, 1.1, 0.9, 1.0, -3.0, -3.0, -3.0])], "candidate string, fold int, value double")
    assert monitor.drift(v, ["candidate"]).first().verdict == "significant"
    i = spark.createDataFrame([(1, "A", date(2020, 1, 1), date(2021, 1, 1)), (1, "B", date(2020, 6, 1), None)], "instrument_id int, symbol string, listed_from date, listed_to date")
    assert [r.symbol for r in quality.overlaps(i).collect()] == ["B"]


def test_streaming_bars(spark, tmp_path):
    ticks = catalog.market.ticks(spark, SF)
    ticks.write.parquet(str(tmp_path / "in"))
    q = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), 60).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("live").toPandas()
    batch = bars.intraday_bars(ticks, 60).withColumn("bar_end", F.expr("timestampadd(MINUTE, bar_end, CAST(date AS TIMESTAMP))")).toPandas()
    keys = ["symbol", "bar_end"]
    both = closed.merge(batch, on=keys, suffixes=("", "_batch"))
    assert len(both) == len(closed) > 500 and not closed.duplicated(keys).any()
    assert all(np.allclose(both[c], both[f"{c}_batch"]) for c in ("open", "high", "low", "close", "volume"))
    # What the watermark hasn't closed yet are the latest bars.
    late = batch.merge(closed[keys], on=keys, how="left", indicator=True).query("_merge == 'left_only'")
    assert len(late) + len(closed) == len(batch) and late["bar_end"].min() >= closed["bar_end"].max()


@pytest.mark.parametrize("name", ["daily_bars", "daily_panel", "session_quality", "fold_gates", "false_discovery", "alpha042", "candidate_grid", "breakout_trades", "outer_decision", "outer_attribution", "drift"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    numbers = [c for c in got.columns if got[c].dtype.kind == "f"]
    assert np.allclose(np.sort(got[numbers].fillna(-9e9).to_numpy(float), 0), np.sort(want[numbers].fillna(-9e9).to_numpy(float), 0))
