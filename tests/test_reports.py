"""Files and views: what is written is read back with the same values."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from test_scenarios import T0, book, frame, snap, wave
from tidebook.operators import backtest, books, quality
from tidebook.operators import estimators as est
from tidebook.plans import more
from tidebook.schema import LATENCY
from tidebook.sources import reports, store, synthetic


def read(spark, path):
    return [r.asDict() for r in spark.read.csv(path, header=True, inferSchema=True).collect()]


def test_csv_round_trip(spark, tmp_path):
    ticks = books.flatten(frame(spark, [snap(i, volume=i) for i in range(5)]))
    flat = ticks.withColumn("timestamp", reports.iso(F.col("ts"))).select("timestamp", *(c for c in ticks.columns if c not in ("seq", "ts")))
    from tidebook.schema import CSV_TICK

    store.write_csv(flat.select(*CSV_TICK.fieldNames()), str(tmp_path / "t"))
    back = store.read_csv(spark, str(tmp_path / "t")).orderBy("ts").collect()
    want = ticks.orderBy("ts").select(*back[0].__fields__).collect()
    assert back == want


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")
    store.write_json(df, str(tmp_path / "j"), "overwrite")
    rows = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(rows, key=lambda r: r["a"]) == [{"a": 1, "b": None}, {"a": 2, "b": 0.5}]
    (tmp_path / "one.json").write_text('{"a": 3,\n "b": 1.5}')
    assert store.read_summary(spark, str(tmp_path / "one.json"), "a int, b double").collect() == [(3, 1.5)]


def test_quarantine_as_json(spark, tmp_path):
    g = quality.gate(frame(spark, [snap(0, ask=99.0), snap(1, symbol=" aaa ")]))
    store.write_json(quality.quarantine(g), str(tmp_path / "q"))
    row = json.loads(spark.read.text(str(tmp_path / "q")).first().value)
    assert row["rejection_reasons"] == ["crossed_or_locked_book"] and row["snapshot"]["seq"] == 0 and set(row) == {"quarantined_at", "rejection_reasons", "repaired_fields", "original_symbol", "snapshot"}
    view = reports.data_quality_view(g).first()
    assert (view["received"], view["accepted"], view["rejected"], view["repaired"], view["acceptance_rate"]) == (2, 1, 1, 1, 0.5) and view["rejected_by_reason"] == {"crossed_or_locked_book": 1}


def test_anomaly_time_is_iso(spark):
    row = [("A", 1, datetime(2026, 9, 7, 9, 15, tzinfo=timezone.utc), "k", "warn", {"z": 1.0}), ("A", 2, datetime(2026, 9, 7, 9, 15, 1, 5, tzinfo=timezone.utc), "k", "warn", {"z": 1.0})]
    got = reports.anomaly_records(spark.createDataFrame(row, "symbol string, seq long, ts timestamp, kind string, severity string, detail map<string,double>")).orderBy("seq").collect()
    assert [r["ts"] for r in got] == ["2026-09-07T09:15:00+00:00", "2026-09-07T09:15:01.000005+00:00"]


def test_backtest_files(spark, tmp_path):
    df = wave(spark)
    strategy = backtest.Strategy(lookback=20)
    reports.write_backtest(df, str(tmp_path), ["A"], strategy)
    trades = read(spark, str(tmp_path / "trades.csv"))
    want = backtest.backtest(df, strategy).collect()
    assert len(trades) == len(want) > 0 and sum(t["pnl"] for t in trades) == pytest.approx(sum(r["pnl"] for r in want))
    assert list(trades[0]) == ["symbol", "entry_tick", "exit_tick", "side", "entry_px", "exit_px", "pnl", "holding_ticks"]
    assert all(t["exit_tick"] - t["entry_tick"] == t["holding_ticks"] for t in trades)
    curve = read(spark, str(tmp_path / "equity.csv"))
    assert len(curve) == df.count() and set(curve[0]) == {"tick", "A"} and curve[-1]["A"] is not None
    row = json.loads(spark.read.text(str(tmp_path / "summary.json")).first().value)
    pnl = [round(r["pnl"], 4) for r in want]
    assert row["num_trades"] == len(want) and row["total_pnl"] == pytest.approx(sum(r["pnl"] for r in want), abs=1e-4) and row["win_rate"] == pytest.approx(sum(p > 0 for p in pnl) / len(pnl), abs=1e-4)
    equity = [c["A"] for c in sorted(curve, key=lambda c: c["tick"])]
    assert row["max_drawdown"] == pytest.approx(max(max(equity[: i + 1]) - e for i, e in enumerate(equity)), abs=1e-3)


def test_summary_without_trades_is_zeros(spark):
    row = reports.rounded(reports.backtest_summary(wave(spark), backtest.Strategy(lookback=20, entry=1e6))).first().asDict()
    assert row.pop("symbol") == "A" and len(row) == 8 and set(row.values()) == {0}


def test_walk_forward_files(spark, tmp_path):
    """A flat price: no profit, no variation; the summary is strict JSON."""
    df = wave(spark).withColumn("midprice", F.lit(100.0))
    folds, summary = backtest.walk_forward(df, backtest.WalkForward(splits=3, cost_bps=0.0), [(1.5, 0.3, 20)])
    reports.write_walk_forward(folds, summary.withColumn("odd", F.lit(float("nan"))), str(tmp_path))
    assert len(read(spark, str(tmp_path / "folds.csv"))) == 3

    def refuse(x):
        raise ValueError(x)

    row = json.loads(spark.read.text(str(tmp_path / "summary.json")).first().value, parse_constant=refuse)
    assert row["cv"] is None and row["odd"] is None and row["symbol"] == "A" and row["passed"] is False


def test_execution_and_timing_files(spark, tmp_path):
    reports.write_execution(book(spark), str(tmp_path), [100, 500])
    rows = read(spark, str(tmp_path / "comparison.csv"))
    assert [(r["strategy"], r["target_qty"]) for r in rows] == [(k, q) for q in (100, 500) for k in ("twap", "vwap")] or len(rows) == 4
    assert all(r["num_fills"] > 0 and r["total_filled"] <= r["target_qty"] and r["avg_fill_price"] == round(r["avg_fill_price"], 4) for r in rows)
    long = spark.createDataFrame([("ofi", 1.0), ("ofi", 3.0), ("vwap", 4.0)], "module string, us double")
    reports.write_timings(long, str(tmp_path))
    assert {r["module"]: r["mean"] for r in read(spark, str(tmp_path / "timings.csv"))} == {"ofi": 2.0, "vwap": 4.0}
    assert {json.loads(r.value)["module"] for r in spark.read.text(str(tmp_path / "summary.json")).collect()} == {"ofi", "vwap"}
    path = str(tmp_path / "latency")
    spark.createDataFrame([tuple(range(len(LATENCY.fields)))], ", ".join(f"{f.name} int" for f in LATENCY.fields)).write.csv(path, header=True)
    assert store.read_latency(spark, path).count() == 1


def test_sample_files(spark, tmp_path):
    source = synthetic.make_source(spark, ticks=120, seed=9, symbols="AAA,BBB")
    reports.write_sample(source, str(tmp_path), 9)
    manifest = json.loads(spark.read.text(str(tmp_path / "manifest.json")).first().value)
    assert (manifest["seed"], manifest["symbols"], manifest["total_ticks"]) == (9, ["AAA", "BBB"], 240)
    assert len(read(spark, str(tmp_path / "metrics.csv"))) == 240
    assert len(read(spark, str(tmp_path / "anomalies.csv"))) == manifest["total_anomalies"]


def test_views(spark):
    ticks = books.flatten(frame(spark, [snap(i, volume=5 * i, symbol="BA"[i % 2]) for i in range(10)])).withColumn("us", F.unix_micros("ts"))
    assert [r["symbol"] for r in reports.symbols_view(ticks).collect()] == ["A", "B"]
    profile = {r["symbol"]: r["profile"] for r in reports.volume_profile_view(ticks).collect()}
    want = {(r["symbol"], r["bucket"]): r["qty"] for r in est.volume_profile(ticks).collect()}
    assert {(s, b): q for s, m in profile.items() for b, q in m.items()} == want
    assert reports.health_view({"alive": True, "fresh": False, "healthy": False}, "mock", ["A"])["status"] == "degraded"
    alerts = est.anomalies(est.order_flow(est.metrics_input(ticks), ()))
    assert reports.recent_alerts_view(alerts, 5).columns == ["seq", "ts", "symbol", "kind", "severity", "detail"]
    assert T0.tzinfo is not None


def test_generated_once_and_in_batches(spark, tmp_path):
    """The batches of the source hold the generator's rows; the metrics of generated ticks read them from one store."""
    start = datetime(2026, 1, 2, 9, 15, tzinfo=timezone.utc)
    want = list(synthetic.snapshots("AAA", 0, 2, 50, 9, 200, start))
    got = [tuple(x.values()) for b in synthetic.batches(iter(want), 16) for x in b.to_pylist()]
    assert [(*x[:3], [tuple(v.values()) for v in x[3]], [tuple(v.values()) for v in x[4]], *x[5:]) for x in got] == want
    rows = [(i, datetime(2024, 1, 1), "view", i % 7, 1.0 + i % 3, '{"k": 3}') for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    df = more.QUERIES["r8_generate"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 40 and plan.count("InMemoryRelation") > 1 and "RelationV2" not in plan
    spark.catalog.clearCache()
