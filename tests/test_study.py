"""Document rules, the store, the classifier of trades and the state of minute files."""

import copy
import datetime as dt
import gzip
import hashlib
import json
import math

import numpy as np
import pytest

from tidemark.operators import documents, filtering, ic, lifecycle, metrics, monitor, quality, walkforward
from tidemark.sources import feed, market, store

H = "a" * 64
BPS = {"zero_bps_per_side": 0.0, "baseline_bps_per_side": 2.5, "double_bps_per_side": 5.0}
PROTOCOL = {
    "schema_version": 1, "protocol_id": "p1", "declared_at": "2026-01-01", "retention_available_after": "2027-01-01",
    "date_windows": {"development": {"start": "2021-01-04", "end": "2024-12-31"}, "outer_test": {"start": "2025-01-01", "end": "2026-06-30"}, "retention": {"start": "2026-07-01", "end": "2026-12-31"}},
    "experiment_budget": {"max_total_experiments": 12}, "costs": BPS, "random_seeds": {"default": 1}, "gates": {"min_outer_trades": 200}, "invalidation_rules": ["changed"],
    "validation": {"train_days": 252, "validation_days": 63, "outer_test_days": 63, "step_days": 63, "purge_days": 20, "embargo_days": 5, "random_seed_required": True},
}
STRATEGY = {
    "schema_version": 1, "spec_id": "s1", "strategy_family": "f", "hypothesis": "h", "universe": {"point_in_time": True}, "features": [{"name": "n", "source": "s", "as_of": "close", "transform": "t"}],
    "label": {"name": "l", "definition": "d", "horizon_days": 1, "cost_included": True}, "holding_period": {"min_days": 1, "max_days": 2, "overnight_allowed": False},
    "parameters": {"search_space_hash": H, "declared": {"x": 1}}, "costs": {"scenarios": BPS, "commission_model": "none"}, "protocol": {"protocol_id": "p1", "protocol_hash": H},
    "data": {"manifest_hash": H, "snapshot_id": "s"}, "experiment_budget": {"max_parameter_trials": 192, "max_model_trials": 50}, "invalidation": ["changed"],
}


def changed(document, path, value):
    out = copy.deepcopy(document)
    *to, last = path.split(".")
    at = out
    for name in to:
        at = at[name]
    at[last] = value
    return out


def test_documents():
    assert documents.accept(PROTOCOL, "protocol") == documents.digest(PROTOCOL)
    assert documents.accept(STRATEGY, "strategy")
    for document, kind, path, value in [
        (PROTOCOL, "protocol", "schema_version", True), (PROTOCOL, "protocol", "costs", {}), (PROTOCOL, "protocol", "gates.min_outer_trades", "x"), (PROTOCOL, "protocol", "date_windows.retention.start", "2026-06-30"),
        (PROTOCOL, "protocol", "retention_available_after", "2026-12-31"), (STRATEGY, "strategy", "features", []), (STRATEGY, "strategy", "holding_period.min_days", 3), (STRATEGY, "strategy", "data.manifest_hash", "A" * 64),
    ]:
        with pytest.raises(ValueError, match=kind):
            documents.accept(changed(document, path, value), kind)
    decision = {
        "schema_version": 1, "report_id": "r", "code_commit": "c", "evidence": {"e": 1}, "decision": {"state": "No-Go", "reasons": ["weak"], "gates": [{"name": "g", "threshold": 1, "observed": 0, "status": "failed"}]},
        "spec_id": "s1", "strategy_family": "f", "spec_hash": documents.digest(STRATEGY), "protocol_hash": H, "data_manifest_hash": H, "experiment_budget": STRATEGY["experiment_budget"],
    }
    assert documents.accept_decision(decision, STRATEGY, ("No-Go",))
    assert "| g | 1 | 0 | failed |" in documents.summary(decision)
    with pytest.raises(ValueError, match="spec_hash"):
        documents.accept_decision(decision | {"spec_hash": "0"}, STRATEGY)
    assert documents.problems({}, "policy")
    assert documents.problems([], "report")


def test_report_and_manifest(tmp_path):
    report = {
        "schema_version": 1, "generated_at": "now", "folds": [], "fold_definition": {"train_days": 1, "test_days": 1, "step_days": 1}, "selection_gates": dict.fromkeys(("min_trades", "min_train_sharpe", "min_train_pf", "validation")),
        "decision_gates": dict.fromkeys(("min_outer_trades", "min_outer_sharpe", "min_outer_pf")), "outer_test_metrics_by_cost": {c: dict.fromkeys(documents.METRICS) for c in documents.COSTS}, "decision": "No-Go", "decision_reasons": [],
        "symbol_attribution_baseline": {"A": 1.0}, "input_meta": [{"grid_spec_hash": lifecycle.grid_hash(lifecycle.grid())}],
    }
    assert documents.problems(report, "report") == []
    assert documents.problems(report | {"input_meta": [{"grid_spec_hash": "x"}]}, "report")
    text = json.dumps(report)
    entry = {"filename": "a.json", "kind": "wf_select", "generated_at": "now", "sha256": hashlib.sha256(text.encode()).hexdigest()}
    manifest = documents.create_only(tmp_path / "m.json", json.dumps({"schema_version": 1, "reports": [entry, entry | {"filename": "b.json"}]}))
    assert documents.manifest_status(manifest)["reports"] == "not-run"
    (tmp_path / "a.json").write_text(text)
    assert documents.manifest_status(manifest)["reports"] == "failed"  # only some are present
    (tmp_path / "b.json").write_text(text)
    assert documents.manifest_status(manifest) == {"manifest": "passed", "reports": "passed", "entries": 2, "present": 2, "missing": 0, "problems": []}
    (tmp_path / "b.json").write_text(text + " ")
    assert documents.manifest_status(manifest)["problems"] == ["b.json: SHA-256 differs"]
    assert documents.manifest_status(tmp_path / "none.json")["manifest"] == "failed"
    with pytest.raises(FileExistsError):
        documents.create_only(manifest, "")


def test_store(spark, tmp_path):
    schema = "instrument_id string, timestamp string, close double"
    a = spark.createDataFrame([("A", "2024-01-02", 1.0), ("A", "2024-01-03", 2.0)], schema)
    again = spark.createDataFrame([("A", "2024-01-03", 2.0), ("B", "2024-01-02", None)], schema)
    found = store.ingest(tmp_path, "p1", [a, again], {"provider": "x"})
    assert (found["rows"], found["first"], found["last"]) == (3, "2024-01-02", "2024-01-03")
    with pytest.raises(FileExistsError):
        store.ingest(tmp_path, "p1", [a], {})
    with pytest.raises(ValueError, match="different rows"):
        store.ingest(tmp_path, "p2", [a, spark.createDataFrame([("A", "2024-01-03", 9.0)], schema)], {})
    store.publish(tmp_path, "s1", ["p1"])
    assert store.read(spark, tmp_path, "s1").count() == 3
    manifest = tmp_path / "snapshots" / "s1.json"
    manifest.write_text(manifest.read_text().replace('"rows": 3', '"rows": 4'))
    with pytest.raises(ValueError, match="hash"):
        store.resolve(tmp_path, "s1")


def test_read_once(tmp_path):
    def fails(first, last):
        raise KeyError(first, last)

    after = dt.date(2027, 1, 1)
    with pytest.raises(PermissionError):
        store.read_once(tmp_path, PROTOCOL, "e1", lambda a, b: (a, b), today=dt.date(2026, 12, 31))
    assert store.read_once(tmp_path, PROTOCOL, "e1", lambda a, b: (a, b), today=after) == (dt.date(2026, 7, 1), dt.date(2026, 12, 31))
    with pytest.raises(KeyError):
        store.read_once(tmp_path, PROTOCOL, "e2", fails, today=after)
    for name in ("e1", "e2"):  # a failed read is used up as well
        with pytest.raises(FileExistsError):
            store.read_once(tmp_path, PROTOCOL, name, lambda a, b: None, today=after)


def test_minute_files(spark, tmp_path):
    head, rows = "ts,open,high,low,close,volume\n", ["2024-01-02T09:30:00-05:00,1,1,1,1,1\n", "2024-01-02T09:31:00-05:00,1,1,1,1,1\n"]
    for name, text in {"good": head + "".join(rows), "head": "".join(rows), "none": head, "twice": head + rows[0] * 2, "back": head + rows[1] + rows[0], "text": head + rows[0] + "x,1\n"}.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "torn.gz").write_bytes(gzip.compress((head + "".join(rows)).encode())[:-9])
    got = {r.path.rpartition("/")[2][:-3]: (r.n_rows, r.problem) for r in market.minute_file_state(spark, f"{tmp_path}/*.gz").collect()}
    assert got == {"good": (2, None), "head": (0, "header"), "none": (0, "no rows"), "twice": (1, "line 3: repeated time"), "back": (1, "line 3: earlier time"), "text": (1, "line 3: no time"), "torn": (0, "gzip: EOFError")}


def test_minute_files_between_days(spark, tmp_path):
    head = "ts,open,high,low,close,volume\n"
    for name, days in {"AA_2024-01-01_2024-01-31": ("2024-01-02", "2024-01-30"), "AA_2024-02-01_2024-02-29": ("2024-02-01",), "BB_2023-01-01_2023-12-31": ("2023-05-05",)}.items():
        text = head + "".join(f"{d}T09:3{k}:00-05:00,1,2,0.5,1,{k}\n" for d in days for k in (0, 1, 1))
        (tmp_path / f"{name}_1min.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "BB_2023-01-01_2023-12-31_1min.csv.gz").write_bytes(b"not opened, its days lie outside")
    got = market.minute_csv_between(spark, str(tmp_path), dt.date(2024, 1, 15), dt.date(2024, 2, 10))
    assert sorted((r.symbol, str(r.ts)) for r in got.collect()) == [("AA", f"2024-0{d} 09:3{k}:00") for d in ("1-30", "2-01") for k in (0, 1)]
    assert market.minute_csv_between(spark, str(tmp_path), dt.date(2025, 1, 1), dt.date(2025, 1, 2)).count() == 0
    rows = market.minute_rows(spark, f"{tmp_path}/AA_2024-01*").collect()
    assert len(rows) == 6 and rows[0].ts == "2024-01-02T09:30:00-05:00" and rows[0].low == "0.5"


def test_latest_files_and_trade_logs(spark, tmp_path):
    for name in ("AA_2023-01-01_2023-12-31", "AA_2023-01-01_2024-06-30", "BB_2022-01-01_2022-12-31"):
        (tmp_path / f"{name}_1min.csv.gz").write_bytes(b"x")
    assert sorted((r.symbol, r.end) for r in market.latest_files(spark, str(tmp_path)).collect()) == [("AA", "2024-06-30"), ("BB", "2022-12-31")]
    schema = "candidate_id string, symbol string, entry_time int, pnl double"
    old = spark.createDataFrame([("c1", "A", 1, 1.0), ("c1", "A", 2, 2.0)], schema)
    both = market.merge_trades(old, spark.createDataFrame([("c1", "A", 2, 9.0), ("c2", "A", 2, 3.0), ("c2", "A", 2, 3.0)], schema))
    assert sorted(tuple(r) for r in both.collect()) == [("c1", "A", 1, 1.0), ("c1", "A", 2, 2.0), ("c2", "A", 2, 3.0)]
    market.write_trades(both, str(tmp_path / "log"), 2)
    assert sorted(r.pnl for r in market.read_trades(spark, str(tmp_path / "log")).collect()) == [1.0, 2.0, 3.0]
    market.write_trades(both.unionByName(old), str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        market.read_trades(spark, str(tmp_path / "twice"))


def test_download_goes_on(spark, tmp_path):
    down = tmp_path / "down"
    down.touch()

    def fetch(symbol, first, last):
        if first.month == 2 and down.exists():
            raise OSError("provider is down")
        yield (dt.datetime.combine(first, dt.time(9, 30)), 1.0, 2.0, 0.5, 1.0, 10.0)

    feed.register(spark, fetch, "feed_that_breaks", tries=1)
    ask = (spark, str(tmp_path / "bars"), ["A", "B"], dt.date(2024, 1, 1), dt.date(2024, 3, 31), "feed_that_breaks")
    with pytest.raises(Exception, match="provider is down"):
        feed.download(*ask)
    down.unlink()
    assert feed.download(*ask) == [dt.date(2024, 2, 1), dt.date(2024, 3, 1)] and feed.download(*ask) == []
    assert spark.read.parquet(f"{tmp_path}/bars/*").count() == 6


def test_quality_report(spark):
    found = spark.createDataFrame([("B", 100, 97, 0, 3, 7, 2, 3.0, True), ("A", 100, 99, 0, 1, 0, 1, 1.0, False)], "symbol string, total_sessions long, full_bar_sessions long, partial_sessions long, zero_bar_sessions long, stale_bar_count long, max_consecutive_gaps long, gap_rate_pct double, has_warning boolean")
    made = quality.report(found, "2024-01-01", "2024-06-30", "2024-07-01")
    assert [r["symbol"] for r in made["symbols"]] == ["A", "B"] and made["summary"] == {"any_warnings": True, "warned_symbols": ["B"]}
    lines = {r.symbol: r.line.split() for r in quality.report_lines(found).collect()}
    assert lines["A"] == ["A", "100", "99", "0", "1", "1.00", "1", "0"] and lines["B"][:8] == ["B", "100", "97", "0", "3", "3.00", "2", "7"] and len(lines["B"]) > 8


def test_cutoff_and_shards(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, k),) for k in (1, 2, 3)], "date date")
    assert ic.until(days, dt.date(2024, 1, 2), dt.date(2024, 1, 2)).count() == 2
    with pytest.raises(ValueError):
        ic.until(days, dt.date(2024, 1, 3), dt.date(2024, 1, 2))
    parts = [[r.candidate_id for r in lifecycle.candidates(spark, shard=k, shards=5).collect()] for k in range(5)]
    assert sorted(map(len, parts)) == [38, 38, 38, 39, 39] and sorted(sum(parts, [])) == sorted(lifecycle.candidate_id(c) for c in lifecycle.grid())


def test_filter(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i // 2), 100.0, 99.0 if i % 2 else 96.0, 104.0, 600 + i % 60, 50.0 if i % 2 else -50.0, 1e4, 1e4) for i in range(240)]
    trades = filtering.labelled(filtering.features(spark.createDataFrame(rows, "exit_date date, entry_price double, stop_price double, target_price double, entry_time int, gross_pnl double, entry_notional double, exit_notional double"))).repartition(1).cache()
    one = trades.orderBy("exit_date", "entry_time").first()
    assert (one.stop_distance, one.target_distance, one.reward_ratio, one.label) == (0.04, 0.04, 1.0, 0.0) and math.isclose(one.session_time, 30 / 390)
    losses = list(filtering.split_losses(trades, rounds=2, splits=2))
    assert len(losses) == 2 and math.isclose(losses[0], math.log(2)) and losses[1] < 0.2  # 30 trades before the first gap, too few to part
    kept = filtering.filtered(trades, trades, rounds=2)
    assert [r.label for r in kept.select("label").distinct().collect()] == [1.0] and kept.count() == 120
    assert filtering.filtered(trades.limit(19), trades, rounds=2).count() == 240


def test_boosting_as_spark_ml_without_its_jobs(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 4))
    x[:, 3] = rng.integers(0, 5, 1200)
    wins = x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + 0.4 * rng.normal(size=1200) > 0
    rows = [(*r, float(w)) for r, w in zip(x.tolist(), wins, strict=True)]
    trades = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*filtering.FEATURES, "label"])).repartition(1).cache()
    plain = VectorAssembler(inputCols=filtering.FEATURES, outputCol="x").transform(trades).withColumn("w", F.when(F.col("label") == 1, 2.5).otherwise(1.0))
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=8, stepSize=0.1, maxDepth=4, minInstancesPerNode=20, featureSubsetStrategy="all").fit(plain)
    want = [r[0] for r in model.transform(plain).select(vector_to_array("probability")[1]).collect()]
    setting = {"num_leaves": 16, "learning_rate": 0.1, "scale_pos_weight": 2.5}
    got = [r[0] for r in filtering.scored(trades, filtering.fit(trades, setting, rounds=8)).select("p_win").collect()]
    assert np.allclose(got, want, rtol=0, atol=1e-12) and len(set(want)) > 50
    spark.sparkContext.setJobGroup("all rounds", "")
    filtering.fit(trades)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("all rounds")
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 8  # two passes, whatever the rounds


def test_boosting_of_missing_values_and_drawn_rows(spark):
    rows = [(float(k % 7) if k % 5 else None, 1.0, float("nan") if k % 11 == 0 else float(k % 3), 0.5, None if k % 50 == 0 else float(k % 7 > 3)) for k in range(600)]
    trades = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in [*filtering.FEATURES, "label"]))
    setting = {"bagging_fraction": 0.6, "bagging_freq": 1, "feature_fraction": 0.5}
    kept = filtering.scored(trades, filtering.fit(trades, setting, rounds=60)).where("stop_distance IS NOT NULL").collect()
    assert len(kept) == 480 and all((r.p_win > 0.5) == (r.stop_distance > 3) for r in kept)
    assert filtering.fit(trades.where("label = 1")) is None


def test_search_stops_bad_trials():
    seen = []

    def losses(trades, setting, rounds):
        for split in range(5):
            seen.append(split)
            yield setting["learning_rate"]

    best, loss, log = filtering.search(None, 20, losses=losses)
    assert len(log) == 20 and loss == best["learning_rate"] == min(t["setting"]["learning_rate"] for t in log)
    assert any(t["stopped"] for t in log) and not any(t["stopped"] for t in log[: filtering.START_UP]) and len(seen) < 100
    for name, (low, high, _) in filtering.RANGES.items():
        assert all(low <= t["setting"][name] <= high for t in log)


def test_feed(spark, tmp_path):
    assert feed.months(dt.date(2024, 1, 15), dt.date(2024, 3, 5)) == [(dt.date(2024, 1, 1), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 5))]

    def fetch(symbol, first, last):
        mark = tmp_path / f"{symbol}{first}"
        if not mark.exists():  # every first try fails
            mark.touch()
            raise ConnectionError
        return [(dt.datetime(first.year, first.month, d), 1.0, 1.0, 1.0, 1.0, float(d)) for d in (1, last.day)]

    feed.register(spark, fetch, "test_feed", pause=0.01)
    rows = spark.read.format("test_feed").options(symbols="B, A", start="2024-01-15", end="2024-02-05").load()
    got = [(r.symbol, r.ts.month, r.volume) for r in rows.orderBy("symbol", "ts").collect()]
    assert got == [(s, m, v) for s in "AB" for m, v in ((1, 1.0), (1, 31.0), (2, 1.0), (2, 5.0))]
    old = spark.createDataFrame([("A", 1, 0.0)], "symbol string, ts int, close double")
    new = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 1.0), ("A", 2, 1.0)], "symbol string, ts int, close double")
    assert sorted(map(tuple, feed.extend(old, new).collect())) == [("A", 1, 0.0), ("A", 2, 1.0)]


def test_trade_shards(spark, tmp_path):
    def put(k, total, grid, trades, meta=True):
        folder = tmp_path / f"shard{k}of{total}"
        folder.mkdir(exist_ok=True)
        (folder / "trades_0000.json").write_text(json.dumps(trades))
        if meta:
            (folder / "meta.json").write_text(json.dumps({"grid_spec_hash": grid, "candidate_shards": total, "candidate_shard": k}))

    def trade(t):
        return {"candidate_id": "c", "symbol": "A", "entry_time": t}

    put(0, 2, "g", [trade(1), trade(2)])
    with pytest.raises(ValueError, match="no meta"):
        put(1, 2, "g", [trade(3)], meta=False)
        market.read_trade_shards(spark, str(tmp_path))
    put(1, 2, "g", [trade(3)])
    assert market.read_trade_shards(spark, str(tmp_path)).count() == 3
    for change, why in ((("h", [trade(3)], 1), "differ"), (("g", [trade(2)], 1), "duplicate")):
        put(1, 2, change[0], change[1])
        with pytest.raises(ValueError, match=why):
            market.read_trade_shards(spark, str(tmp_path))
    put(1, 2, "g", [trade(3)])
    put(3, 4, "g", [trade(4)])
    with pytest.raises(ValueError, match="complete"):
        market.read_trade_shards(spark, str(tmp_path))


def test_verdict_and_panel(spark, tmp_path):
    rows = [("a", "sharpe", 5, 0.1, 0.01), ("b", "sharpe", 5, -0.1, 0.01), ("c", "sharpe", 5, 0.1, 0.5), ("c", "mean_net_bps", 5, None, None), ("d", "sharpe", 1, 0.1, 0.01)]
    tests = spark.createDataFrame(rows, "run string, metric string, n int, mean_diff double, p_value double")
    got = {r.run: r.verdict for r in monitor.comparison_verdict(tests, ["run"]).collect()}
    assert got == {"a": "significantly_better", "b": "significantly_worse", "c": "no_significant_improvement", "d": "insufficient_data"}
    bars = spark.createDataFrame([("B", dt.date(2024, 1, 2), *[1.0] * 5), ("A", dt.date(2024, 1, 2), *[2.0] * 5)], "symbol string, date date, open double, high double, low double, close double, volume double")
    market.export_panel(bars.coalesce(1), str(tmp_path / "panel"))
    back = spark.read.option("header", True).csv(str(tmp_path / "panel"))
    assert back.columns == ["datetime", "instrument", "$open", "$high", "$low", "$close", "$volume"] and back.count() == 2


def test_filtered_trades_learns_all_rounds(spark, monkeypatch):
    from tidemark import catalog

    seen = []
    monkeypatch.setattr(filtering, "fit", lambda train, parameters=None, rounds=filtering.ROUNDS: seen.append(rounds))
    catalog.QUERIES["filtered_trades"](spark, "/root/testdata/sf0.001")
    assert seen == [200]


def plain_metrics(days, trades):
    """Metrics of (day, net, notional) over all days, each day written out."""
    net = np.array([n for _, n, _ in trades])
    daily = np.array([sum(n for d, n, _ in trades if d == x) for x in days]) / metrics.CAPITAL
    equity = np.cumsum(daily)
    fall = (np.maximum(0, np.maximum.accumulate(equity)) - equity).max()
    sharpe = daily.mean() / daily.std() * math.sqrt(252) if len(days) > 1 and daily.std() > 1e-15 else None
    factor = net[net > 0].sum() / -net[net < 0].sum() if (net < 0).any() else None
    return len(net), (net > 0).mean(), factor, np.mean([n / v for _, n, v in trades]) * 10_000, net.sum(), sharpe, fall


def test_metrics_from_daily_cells(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    of = {k: [(days[int(d)], float(n), float(v)) for d, n, v in zip(rng.integers(0, 60, 40 * k), rng.normal(1, 50, 40 * k), rng.uniform(900, 1100, 40 * k), strict=True)] for k in (1, 2, 3)}
    of |= {4: [(d, 5.0, 1000.0) for d in days], 5: [(days[7], -5.0, 1000.0)]}  # the same every day; a single loss
    rows = spark.createDataFrame([(k, *t) for k, ts in of.items() for t in ts], "candidate int, exit_date date, net double, entry_notional double")
    cells = metrics.daily_cells(rows, ["candidate"])
    total = spark.createDataFrame([(60,)], "days long")
    names = ["trades", "win_rate", "profit_factor", "mean_net_bps", "total_net_pnl", "sharpe", "max_drawdown"]
    got = {r.candidate: [r[n] for n in names] for r in metrics.cell_metrics(cells, ["candidate"], total).collect()}
    assert got.keys() == of.keys()
    for k, ts in of.items():
        want = plain_metrics(days, ts)
        assert [x is None for x in got[k]] == [x is None for x in want]
        assert np.allclose([x for x in got[k] if x is not None], [x for x in want if x is not None])


def test_run_written_and_extended(spark, tmp_path):
    schema = "candidate_id string, symbol string, entry_time int, gross_pnl double"
    old = spark.createDataFrame([("c1", "A", 1, 1.0), ("c1", "A", 2, 2.0)], schema)
    new = spark.createDataFrame([("c1", "A", 2, 9.0), ("c2", "B", 3, 3.0)], schema)
    for name in ("a", "b"):
        (tmp_path / f"in_{name}.gz").write_bytes(name.encode())
    files = market.file_hashes(spark, str(tmp_path / "in_*.gz"))
    market.write_run(old, str(tmp_path / "one"), "g", ["A"], "2024-01-02", "2024-01-31", files=files)
    market.extend_run(spark, str(tmp_path / "one"), new, str(tmp_path / "two"), "g", "2024-02-01", "2024-02-29")
    trades, metas = market.read_run(spark, str(tmp_path / "two"))
    assert sorted(tuple(r) for r in trades.collect()) == [("c1", "A", 1, 1.0), ("c1", "A", 2, 2.0), ("c2", "B", 3, 3.0)]
    m = metas.first()
    assert (m.grid_spec_hash, m.start, m.end, m.trade_count, m.universe) == ("g", "2024-01-02", "2024-02-29", 3, ["A"]) and m.rolled_from == str(tmp_path / "one")
    listed = spark.read.json(str(tmp_path / "one" / "shard0of1" / "cache_manifest.json")).collect()
    assert {r.sha256 for r in listed} == {hashlib.sha256(x).hexdigest() for x in (b"a", b"b")}
    with pytest.raises(ValueError, match="grid"):
        market.extend_run(spark, str(tmp_path / "one"), new, str(tmp_path / "three"), "other", "2024-02-01", "2024-02-29")
    with pytest.raises(Exception, match="already exists"):
        market.write_run(old, str(tmp_path / "one"), "g", ["A"], "2024-01-02", "2024-01-31")
    for k in (0, 2):
        market.write_run(old, str(tmp_path / "part"), "g", ["A"], "2024-01-02", "2024-01-31", k, 3)
    with pytest.raises(ValueError, match="complete"):
        market.read_run(spark, str(tmp_path / "part"))


def test_walk_forward_report(spark):
    trades = market.pseudo_trades(spark, "/root/testdata/sf0.01").where("candidate <= 30")
    meta = [{"grid_spec_hash": lifecycle.grid_hash(lifecycle.grid())}]
    found = walkforward.report(trades, meta, "2024-01-01T00:00:00")
    assert documents.problems(found, "report") == [] and json.loads(json.dumps(found)) is not None
    base, chosen = found["outer_test_metrics_by_cost"]["baseline"], [f for f in found["folds"] if f["selected"] is not None]
    assert len(found["folds"]) > 10 and len(chosen) > 3 and base["trades"] == sum(f["test_metrics"]["trades"] or 0 for f in chosen)
    assert math.isclose(sum(found["symbol_attribution_baseline"].values()), base["total_net_pnl"], rel_tol=1e-9, abs_tol=1e-6)
    assert all(f["train_max"] < f["validation_min"] <= f["validation_max"] < f["test_min"] for f in found["folds"])
    nothing = walkforward.report(trades.limit(0), meta, "2024-01-01T00:00:00")
    assert nothing["decision"] == "No-Go" and nothing["folds"] == []


def test_drift_counts_folds_without_values(spark):
    values = spark.createDataFrame([("sharpe", k, None if k == 2 else float(x)) for k, x in enumerate([1, 2, 9, 1, -9, -9, -9])], "metric string, fold int, value double")
    r = monitor.drift(values, ["metric"]).first()
    assert r.n_reference == 4 and np.isclose(r.z, (-9 - 4 / 3) / np.std([1, 2, 1], ddof=1)) and r.verdict == "significant"
    rows = [("a", "stable", 5), ("a", "moderate", 5), ("b", "insufficient_data", 5), ("c", "stable", 2)]
    verdicts = spark.createDataFrame(rows, "run string, verdict string, n_reference int")
    assert {r.run: r.verdict for r in monitor.worst(verdicts, ["run"]).collect()} == {"a": "moderate", "b": "stable", "c": "insufficient_data"}


def test_instrument_of_a_symbol(spark):
    day = dt.date
    listed = spark.createDataFrame([(1, "A", day(2020, 1, 1), day(2021, 1, 1)), (2, "A", day(2020, 6, 1), None), (3, "B", day(2020, 1, 1), None)], "instrument_id int, symbol string, listed_from date, listed_to date")
    asked = spark.createDataFrame([("A", day(2020, 2, 1)), ("A", day(2020, 7, 1)), ("A", day(2021, 1, 1)), ("C", day(2020, 2, 1)), ("B", day(2019, 1, 1))], "symbol string, date date")
    got = {(r.symbol, r.date): (r.n, r.instrument_id) for r in quality.instrument_at(asked, listed).collect()}
    assert got == {("A", day(2020, 2, 1)): (1, 1), ("A", day(2020, 7, 1)): (2, None), ("A", day(2021, 1, 1)): (1, 2), ("C", day(2020, 2, 1)): (0, None), ("B", day(2019, 1, 1)): (0, None)}
