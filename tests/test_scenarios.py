"""Scenarios of single operators, with values worked out by hand from their definitions."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidebook.operators import alerts, backtest, books, execution, quality, research
from tidebook.operators import estimators as est
from tidebook.schema import METRICS, SNAPSHOT, TICK, require
from tidebook.sources import store, synthetic
from tidebook.streaming import live

T0 = datetime(2026, 9, 7, 9, 15, tzinfo=timezone.utc)


def snap(seq, bid=100.0, ask=100.5, bq=100, aq=100, ltp=None, ltq=1, volume=0, ts=None, symbol="AAA", levels=5):
    b = [(bid - 0.5 * i, bq if i == 0 else 50, 1) for i in range(levels)]
    a = [(ask + 0.5 * i, aq if i == 0 else 50, 1) for i in range(levels)]
    return (seq, symbol, ts or T0 + timedelta(seconds=seq), b, a, (bid + ask) / 2 if ltp is None else ltp, ltq, volume)


def frame(spark, rows):
    return spark.createDataFrame(rows, SNAPSHOT)


def flat(spark, rows):
    return books.flatten(frame(spark, rows)).withColumn("us", F.unix_micros("ts"))


def column(df, name):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_spreads(spark):
    r = books.spreads(flat(spark, [snap(0)])).first()
    assert r["spread"] == 0.5 and r["relative_spread"] == pytest.approx(0.5 / 100.25) and r["weighted_spread"] is not None


def test_one_sided_book_has_no_spread(spark):
    r = books.spreads(flat(spark, [(0, "AAA", T0, [], [(100.5, 10, 1)], 100.0, 1, 0)])).first()
    assert r["spread"] is None and r["midprice"] is None and r["weighted_spread"] is None


def test_flow_event_of_a_better_bid(spark):
    df = est.order_flow(flat(spark, [snap(0), snap(1, bid=100.1, bq=80)]))
    assert column(df, "ofi") == [0.0, 80.0]


def test_flow_leaves_the_window(spark):
    rows = [snap(0), snap(1, bq=150), snap(2, bq=150, ts=T0 + timedelta(seconds=62))]
    assert column(est.order_flow(flat(spark, rows)), "ofi_60s") == [0.0, 50.0, 0.0]


def test_flow_window_includes_its_edge(spark):
    rows = [snap(0), snap(1, bq=150), snap(2, bq=150, ts=T0 + timedelta(seconds=61))]
    assert column(est.order_flow(flat(spark, rows)), "ofi_60s") == [0.0, 50.0, 50.0]


def test_session_vwap(spark):
    rows = [snap(i, ltp=p, volume=v) for i, (p, v) in enumerate([(100.25, 0), (101.0, 1000), (99.0, 3000)])]
    assert column(est.sessions(flat(spark, rows)), "vwap")[-1] == pytest.approx(299000 / 3000)


def test_vwap_restarts_with_the_volume(spark):
    rows = [snap(i, ltp=p, volume=v) for i, (p, v) in enumerate([(100.0, 100), (101.0, 120), (110.0, 0), (105.0, 10)])]
    assert column(est.sessions(flat(spark, rows)), "vwap") == [None, 101.0, None, 105.0]


@pytest.mark.parametrize("n,total", [(2, 20), (3, None), (4, 10), (5, None)])
def test_profile_of_the_current_session(spark, n, total):
    rows = [snap(0, volume=100), snap(1, volume=120), snap(2, volume=0), snap(3, volume=10), snap(4, volume=100, ts=T0 + timedelta(days=1))][:n]
    assert est.volume_profile(flat(spark, rows)).agg(F.sum("qty")).first()[0] == total


def test_tick_rule(spark):
    rows = [snap(i, ltp=p) for i, p in enumerate([100.0, 100.1, 100.1, 99.9])]
    assert column(est.tick_rule(flat(spark, rows), "s", F.lit(True)), "s") == [0, 1, 1, -1]


def test_estimators_skip_rows_that_do_not_count(spark):
    """The last w valid rows, whatever lies between: Amihud by hand with a window of two."""
    rows = [snap(0, bid=100, ask=101), snap(1, bid=101, ask=102, ltp=100.0, ltq=10), snap(2, ltq=None), snap(3, bid=102, ask=103, ltp=100.0, ltq=10), snap(4, bid=103, ask=104, ltp=100.0, ltq=10)]
    got = column(est.amihud(books.spreads(flat(spark, rows)), window=2), "amihud_illiq")
    ratio = lambda a, b: abs(b - a) / a * 1e4 / 1000 * 1e6
    one, two, three = ratio(100.5, 101.5), ratio(101.5, 102.5), ratio(102.5, 103.5)
    assert got[0] is None and got[2] is None
    assert got[1] == pytest.approx(one) and got[3] == pytest.approx((one + two) / 2) and got[4] == pytest.approx((two + three) / 2)


def test_alert_after_a_burst_of_flow(spark):
    rows = [(i, "AAA", T0 + timedelta(seconds=i), 0.5, float(100 if i == 20 else 1 + i % 2), 0) for i in range(21)]
    df = spark.createDataFrame(rows, "seq long, symbol string, ts timestamp, spread double, ofi double, volume long")
    got = est.anomalies(df, window=10, threshold=2.0).collect()
    assert [(r["seq"], r["kind"], r["severity"]) for r in got] == [(20, "ofi_extreme", "critical")]


def test_metrics_have_their_fields(spark):
    ticks = books.flatten(synthetic.make_source(spark, ticks=120, seed=7, symbols="AAA"))
    df = est.metrics(ticks)
    assert [c for c in df.columns if c in METRICS] == METRICS
    last = df.orderBy(F.desc("seq")).first()
    assert df.count() == 120 and last["kyle_lambda"] is not None and 0 <= last["trade_variance_share"] <= 1


def test_synthetic_source_is_reproducible(spark):
    one, two, other = (synthetic.make_source(spark, ticks=20, seed=s, symbols="AAA,BBB").orderBy("seq").collect() for s in (99, 99, 98))
    assert one == two and one != other and len(one) == 40
    with pytest.raises(Exception, match="symbol"):
        synthetic.make_source(spark, symbols=" ,").collect()


def test_gate_repairs_only_the_symbol(spark):
    g = quality.gate(frame(spark, [snap(0, symbol="  aaa ")]))
    r = g.first()
    assert r["symbol"] == "AAA" and r["accepted"] and r["repaired_fields"] == ["symbol"]
    assert quality.counters(g).first().asDict() == {"received": 1, "accepted": 1, "rejected": 0, "repaired": 1}


def test_gate_rejection_does_not_move_the_state(spark):
    rows = [snap(0, bid=100.0, ask=99.95, ts=T0), snap(1, ts=T0)]
    assert column(quality.gate(frame(spark, rows)), "reasons") == [["crossed_or_locked_book"], []]


def test_gate_sequence(spark):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    rows = [snap(0, volume=100, ts=at(0)), snap(1, volume=101, ts=at(10)), snap(2, volume=101, ts=at(9)), snap(3, volume=50, ts=at(11)), snap(4, volume=102, ts=at(11))]
    assert column(quality.gate(frame(spark, rows)), "reasons") == [[], [], ["non_monotonic_timestamp"], ["cumulative_volume_decrease"], []]


@pytest.mark.parametrize(
    "change,code",
    [
        ({"symbol": None}, "invalid_symbol"), ({"symbol": "  "}, "empty_symbol"), ({"symbol": "ZZZ"}, "unknown_symbol"), ({"ltp": float("nan")}, "invalid_ltp"), ({"ltq": -1}, "invalid_ltq"), ({"volume": -1}, "invalid_volume"),
        ({"bq": 0}, "invalid_book_level"), ({"levels": 0}, "invalid_book_depth"), ({"levels": 6}, "invalid_book_depth"), ({"bid": 100.5}, "crossed_or_locked_book"),
    ],
)
def test_gate_codes(spark, change, code):
    assert quality.gate(frame(spark, [snap(0, **change)]), ("AAA",)).first()["reasons"] == [code]


def test_gate_book_order(spark):
    b, a = [(100.0, 1, 0), (100.1, 1, 0)], [(101.0, 1, 0), (100.9, 1, 0)]
    got = quality.gate(frame(spark, [(0, "A", T0, b, a, 100.5, 1, 1)])).first()["reasons"]
    assert got == ["bids_not_descending", "asks_not_ascending"]
    got = quality.gate(frame(spark, [(0, "A", None, None, a, 100.5, 1, 1)])).first()["reasons"]
    assert got == ["invalid_timestamp", "invalid_book_depth"]


def test_store_round_trip(spark, tmp_path):
    rows = [snap(i, ltp=100 + 0.01 * i, volume=50 * (i + 1), ts=T0.replace(hour=9, minute=14, second=30) + timedelta(seconds=10 * i)) for i in range(10)]
    root = str(tmp_path / "store")
    store.append(books.flatten(frame(spark, rows[:5])), root)
    store.append(books.flatten(frame(spark, rows[5:])), root)
    back = store.read_day(spark, root, "AAA", "2026-09-07")
    assert back.columns == TICK.fieldNames()
    assert [round(r["ltp"], 2) for r in back.collect()] == [round(100 + 0.01 * i, 2) for i in range(10)]
    assert {r["bucket"] for r in store.placed(books.flatten(frame(spark, rows))).select("bucket").distinct().collect()} == {"0900", "0915"}
    assert store.read_day(spark, root, "AAA", "2026-09-08").count() == 0
    assert store.read_day(spark, str(tmp_path / "none"), "AAA", "2026-09-08").count() == 0


def test_store_prunes_partitions(spark, tmp_path):
    root = str(tmp_path / "store")
    store.append(books.flatten(frame(spark, [snap(0)])), root)
    plan = store.read_day(spark, root, "AAA", "2026-09-07")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


SERIES = list(zip(range(10), [100.0, 100.0, 101.0, 102.0, 102.0, 101.0, 100.0, 99.0, 99.0, 100.0], [0.0, 0.0, 5.0, 6.0, 0.0, 0.0, -5.0, -6.0, 0.0, 0.0]))


def test_backtest_reconciles(spark):
    df = spark.createDataFrame([("A", *r) for r in SERIES], "symbol string, seq long, midprice double, ofi_300s double")
    how = backtest.Strategy(lookback=3, entry=1.0, exit=0.4, cost_bps=1.0)
    t, e = backtest.backtest(df, how), backtest.equity(df, how)
    total = t.agg(F.sum("pnl")).first()[0]
    assert t.count() > 0 and e.orderBy(F.desc("seq")).first()["equity"] == pytest.approx(how.capital + total)
    with pytest.raises(ValueError, match="ofi_300s"):
        backtest.backtest(df.drop("ofi_300s"), how)


def test_backtest_is_a_state_machine(spark):
    import random

    r = random.Random(4)
    rows = [(f"S{k}", i, 100 + r.gauss(0, 1), r.gauss(0, 1)) for k in range(6) for i in range(200)]
    how = backtest.Strategy(lookback=20, entry=1.2, exit=0.4)
    df = spark.createDataFrame(rows, "symbol string, seq long, midprice double, ofi_300s double")
    z = {(x["symbol"], x["seq"]): x["z"] for x in backtest.signals(df, how, ["symbol"]).collect()}
    want = []
    for k in range(6):
        pos = None
        for s, i, px, _ in [x for x in rows if x[0] == f"S{k}"]:
            v = z[s, i]
            if pos is None and abs(v) > how.entry:
                pos = (i, 1 if v > 0 else -1)
            elif pos is not None and abs(v) < how.exit:
                want.append((s, pos[0], i, pos[1]))
                pos = None
        if pos is not None:
            want.append((f"S{k}", pos[0], 199, pos[1]))
    got = [tuple(x) for x in backtest.backtest(df, how).select("symbol", "entry_seq", "exit_seq", "side").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50


def wave(spark, n=600):
    import math

    return spark.createDataFrame([("A", t, 100 + 0.01 * t + math.sin(t / 9), 10 * math.sin(t / 5)) for t in range(n)], "symbol string, seq long, midprice double, ofi_300s double")


def test_walk_forward(spark):
    grid = [(1.0, 0.4, 50)]
    folds, summary = backtest.walk_forward(wave(spark), backtest.WalkForward(splits=4), grid)
    rows = folds.orderBy("fold").collect()
    assert [r["test_start"] for r in rows] == [120, 240, 360, 480] and all(r["train_end"] == r["test_start"] and r["cost_bps"] == 10.0 for r in rows)
    cheap, _ = backtest.walk_forward(wave(spark), backtest.WalkForward(splits=4, cost_bps=0.0), grid)
    assert summary.first()["total_pnl"] <= cheap.agg(F.sum("test_pnl")).first()[0]


def plain_run(rows, entry, exit, cost):
    """(trades as (pnl, entry price), deepest fall) of a state machine over rows (price, z); the last row closes."""
    pos, done, trades, peak, fall, c = None, 0.0, [], -1e300, 0.0, cost / 1e4
    for i, (px, z) in enumerate(rows):
        if pos is None and abs(z) > entry:
            pos = (px, 1 if z > 0 else -1)
        elif pos is not None and abs(z) < exit:
            trades.append((pos[1] * (px - pos[0]) - c * pos[0] - c * px, pos[0]))
            done, pos = done + trades[-1][0], None
        if pos is not None and i == len(rows) - 1:
            trades.append((pos[1] * (px - pos[0]) - c * pos[0] - c * px, pos[0]))
            done, pos = done + trades[-1][0], None
        equity = done + (pos[1] * (px - pos[0]) - c * pos[0] if pos else 0.0)
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
    return trades, fall


def plain_scores(values, n):
    import statistics

    out = []
    for i, v in enumerate(values):
        past = [x for x in values[max(0, i - n) : i] if x is not None]
        std = statistics.stdev(past) if len(past) > 1 else 0.0
        out.append((v - statistics.fmean(past)) / std if std > 1e-12 and v is not None else 0.0)
    return out


def test_merged_blocks_are_each_fold_run_alone(spark, monkeypatch):
    import random
    import statistics

    from tidebook.operators import estimators

    for name, value in (("LEAST", 32), ("SHARE", 8), ("BUCKET", 16)):
        monkeypatch.setattr(estimators, name, value)
    r = random.Random(8)
    data = {s: [(3 * i + r.randint(0, 2), 100 + r.gauss(0, 1), None if r.random() < 0.05 else float(r.randint(-3, 3))) for i in range(n)] for s, n in (("A", 103), ("B", 61), (None, 80))}
    df = spark.createDataFrame([(s, *x) for s, rows in data.items() for x in rows], "symbol string, seq long, price double, _value double")
    config, grid, cost = backtest.WalkForward(splits=4), [(1.0, 0.3, 5), (1.4, 0.0, 8), (9.0, 0.1, 5), (0.4, 0.4, 8)], 3.0
    rows = backtest.blocks(df, config, ["symbol"])
    parts = backtest.block_summaries(rows.select("symbol", "seq", "price", "_value", "block", (F.col("block") == config.splits).alias("_last")), grid, cost, ["symbol"])
    got = {(x["symbol"], x["fold"], x["split"], x["cand"]): x for x in backtest.merged(parts, config, ["symbol"]).collect()}
    assert len(got) == 3 * 4 * 2 * len(grid)
    for s, rows in data.items():
        size = len(rows) // 5
        for fold in range(1, 5):
            start = len(rows) - (5 - fold) * size
            for split, part in (("train", rows[:start]), ("test", rows[start : start + size])):
                for cand, (entry, exit, n) in enumerate(grid):
                    z = plain_scores([v for _, _, v in part], n)
                    trades, fall = plain_run([(px, v) for (_, px, _), v in zip(part, z)], entry, exit, cost)
                    x = got[s, fold, split, cand]
                    p = [round(pnl, 4) for pnl, _ in trades]
                    each = [v / round(px, 4) for v, (_, px) in zip(p, trades)]
                    gain, loss = sum(v for v in p if v > 0), -sum(v for v in p if v < 0)
                    sharpe = statistics.fmean(each) / statistics.stdev(each) if len(each) > 1 and statistics.stdev(each) > 1e-12 else 0.0
                    assert x["trades"] == len(trades)
                    want = (sum(v for v, _ in trades), fall, sum(v > 0 for v in p) / max(len(p), 1), sharpe)
                    assert (x["total_pnl"], x["max_drawdown"], x["win_rate"], x["sharpe"]) == pytest.approx(want, abs=1e-5, rel=1e-5), (s, fold, split, cand)
                    assert x["profit_factor"] == pytest.approx(0.0 if not p else float("inf") if loss <= 1e-12 else gain / loss, rel=1e-4)


def test_walk_forward_by_chunks(spark, monkeypatch):
    """A run's rows are several chunks, each with parts of its own; the choice and its results are those of one chunk."""
    from tidebook.operators import estimators

    df, config, grid = wave(spark), backtest.WalkForward(splits=3), [(1.0, 0.4, 50), (1.5, 0.2, 40)]
    want = [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in backtest.walk_forward(df, config, grid)[0].orderBy("symbol", "fold").collect()]
    for name, value in (("LEAST", 32), ("SHARE", 8), ("BUCKET", 16)):
        monkeypatch.setattr(estimators, name, value)
    rows = backtest.blocks(df.select("symbol", "seq", F.col("midprice").alias("price"), F.col("ofi_300s").cast("double").alias("_value")), config, ["symbol"])
    parts = backtest.block_summaries(rows.select("symbol", "seq", "price", "_value", "block", (F.col("block") == 3).alias("_last")), grid, 10.0, ["symbol"])
    assert parts.where("run = 0").select("chunk").distinct().count() > 3
    assert [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in backtest.walk_forward(df, config, grid)[0].orderBy("symbol", "fold").collect()] == want


def test_walk_forward_fails_with_reasons(spark):
    _, s = backtest.walk_forward(wave(spark), backtest.WalkForward(splits=3, cost_bps=100.0, least_ratio=1.0, most_cv=0.0), [(1.0, 0.4, 50)])
    r = s.first()
    assert not r["passed"] and not r["stable"] and r["reasons"]
    with pytest.raises(ValueError):
        backtest.walk_forward(wave(spark, 200), backtest.WalkForward(splits=3), [(1.0, 0.4, 50)])
    with pytest.raises(ValueError):
        backtest.WalkForward(splits=1)


def book(spark):
    rows = [("A", t, 100.05 + 0.01 * t, 50 + t, 1000 + 50 * t, *[x for k in range(5) for x in (100 - 0.05 * k + 0.01 * t, 100, 100.1 + 0.05 * k + 0.01 * t, 100)]) for t in range(20)]
    levels = ", ".join(f"bid_px_{k} double, bid_qty_{k} long, ask_px_{k} double, ask_qty_{k} long" for k in range(1, 6))
    return spark.createDataFrame(rows, f"symbol string, seq long, ltp double, ltq long, volume long, {levels}")


@pytest.mark.parametrize("kind", ["twap", "vwap"])
@pytest.mark.parametrize("side", ["buy", "sell"])
def test_execution_fills_exactly(spark, kind, side):
    fills, summary = execution.simulate(book(spark), kind, 500, 5, side)
    assert fills.agg(F.sum("qty")).first()[0] == 500
    r = summary.first()
    assert r["avg_fill_price"] == r["avg_fill_price"] and (r["implementation_shortfall_bps"] is not None)


def test_execution_partial_fill_and_errors(spark):
    assert execution.simulate(book(spark), "twap", 5000, 5)[1].first()["filled_qty"] == 2500
    with pytest.raises(ValueError, match="at least one tick"):
        execution.simulate(book(spark).limit(0), "twap", 500)
    with pytest.raises(ValueError, match="volume"):
        execution.simulate(book(spark).drop("volume"), "twap", 500)


def test_as_of_tie_goes_back(spark):
    left = spark.createDataFrame([(0, "A", 10), (1, "A", 3), (2, "B", 5), (3, "A", None)], "seq long, symbol string, t long")
    right = spark.createDataFrame([("A", 8, 1.0), ("A", 12, 2.0), ("A", 3, 3.0)], "symbol string, t long, v double")
    got = {r["seq"]: r["v"] for r in research.as_of(left, right, "t", ["symbol"], ["v"]).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: None, 3: None}


def test_alert_history(spark):
    a = spark.createDataFrame([(i, 0) for i in range(700)], "seq long, place int")
    last = alerts.last_alerts(a, 1000).collect()
    assert len(last) == 500 and last[-1]["seq"] == 699 and last[0]["seq"] == 200
    assert [r["seq"] for r in alerts.last_alerts(a.where("seq < 50"), 10).collect()] == list(range(40, 50))
    assert alerts.last_alerts(a, 0).count() == 0


def test_queue_drops_the_oldest(spark):
    m = spark.createDataFrame([("book:A", i) for i in range(201)], "topic string, seq long")
    held, drops = alerts.drop_oldest(m)
    assert held.count() == 200 and held.agg(F.min("seq")).first()[0] == 1 and drops.first()["dropped"] == 1


def test_rate_limit(spark):
    c = spark.createDataFrame([(i, k, 0) for i, k in enumerate("aaabbb")], "seq long, k string, us long")
    assert column(alerts.rate_limit(c, "k", "us", 2), "allowed") == [True, True, False] * 2
    assert all(column(alerts.rate_limit(c, "k", "us", 0), "allowed"))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        require(spark.createDataFrame([(1,)], "a int"), "a", "c", "b")


def test_stream_equals_batch(spark, tmp_path):
    """All fields, alerts and counters of the stream, over several batches, are those of the batch estimators."""
    how = {"ticks": 400, "rate": 150, "seed": 3, "symbols": "AAA,BBB"}
    totals = live.Totals()
    spark.streams.addListener(totals)
    stream = live.observed(live.gated(synthetic.make_source(spark, stream=True, **how)))
    out = str(tmp_path / "out")
    failures = Counter()

    def broken(batch, epoch):
        raise OSError("disk full")

    sinks = {"metrics": lambda b, e: b.write.mode("append").parquet(out), "cache": live.upsert_latest(spark, str(tmp_path / "cache")), "quarantine": broken}
    q = live.fan_out(stream, sinks, str(tmp_path / "cp"), failures=failures, may_fail=("quarantine",))
    q.processAllAvailable()
    assert live.health(q)["healthy"]
    q.stop()
    got = {r["seq"]: r for r in spark.read.parquet(out).collect()}
    ticks = books.flatten(synthetic.make_source(spark, **how))
    want = est.zscores(est.order_flow(est.metrics_input(ticks), ())).select("seq", "z_spread", "z_volume", "z_ofi", "ofi").join(est.metrics(ticks), "seq").collect()
    assert len(got) == len(want) == 800
    for r in want:
        for name in (*live.FIELDS, *live.PASSED):
            least = 1e-4 if name == "vwap_stdev" else 1e-9  # the root of what rounding leaves of equal prices
            a, b = got[r["seq"]][name], r[name]
            assert a == pytest.approx(b, rel=1e-6, abs=least) if b is not None else a is None, (r["seq"], name)
    alerts_ = {(r["seq"], r["kind"]): (r["severity"], r["detail"]) for r in live.alerts_of(spark.read.parquet(out)).collect()}
    plain = {(r["seq"], r["kind"]): (r["severity"], r["detail"]) for r in est.anomalies(est.order_flow(est.metrics_input(ticks), ())).collect()}
    assert alerts_ == plain and plain
    for _ in range(100):
        if totals.counts.get("received") == 800:
            break
        time.sleep(0.1)
    spark.streams.removeListener(totals)
    assert totals.counts["accepted"] == 800 and totals.counts["rejected"] == 0 and totals.counts["alerts"] == len(plain)
    assert failures["quarantine"] >= 3
    text = live.exposed(live.series(totals, failures, {"book:AAA": 2}, {"alerts": 1}, now_us=totals.last_us + 1_500_000))
    assert "ticks_ingested_total 800\n" in text and "last_tick_lag_seconds 1.5\n" in text and 'ws_clients{topic="book:AAA"} 2' in text and f"quarantine_write_failures_total {failures['quarantine']}" in text
    assert len(live.series(live.Totals(), clients={"a": 0}, dropped={"a": 0})) == 10 and "last_tick_lag_seconds -1.0" in live.exposed(live.series(live.Totals()))


def test_stream_rejects_and_counts(spark, tmp_path):
    """A late tick and a bad book are rejected in the stream with their codes; the state goes on."""
    rows = [snap(0, volume=10), snap(1, volume=20, ts=T0), snap(2, volume=30, ask=99.0), snap(3, volume=40, symbol=" aaa ")]
    src = str(tmp_path / "in")
    frame(spark, rows).coalesce(1).write.parquet(src)
    g = live.gated(spark.readStream.schema(SNAPSHOT).parquet(src))
    q = live.fan_out(g, {"all": lambda b, e: b.write.mode("append").parquet(str(tmp_path / "out"))}, str(tmp_path / "cp"), accepted_only=())
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[i]["reasons"] for i in range(4)] == [[], ["non_monotonic_timestamp"], ["crossed_or_locked_book"], []]
    assert got[3]["repaired"] and got[3]["symbol"] == "AAA" and got[1]["vwap"] is None


def test_restart_backs_off():
    waits, runs = [], []

    class Query:
        def awaitTermination(self):
            runs.append(1)
            if len(runs) < 4:
                raise RuntimeError("source failed")

    assert live.supervise(Query, sleep=waits.append) == 3 and waits == [1.0, 2.0, 4.0]
    assert live.backoff(20) == 60.0


def test_gate_agrees_with_a_plain_pass(spark):
    """Random arrivals: late rows, falling and missing volumes, new days, bad books."""
    r = random.Random(3)
    rows, at, volume = [], T0, 0
    for seq in range(600):
        at += timedelta(seconds=r.choice([1, 1, 1, 5, 40_000 if r.random() < 0.02 else 1]))
        volume = r.randint(0, 50) if r.random() < 0.02 else volume + r.randint(0, 9)
        ts = at - timedelta(seconds=r.choice([0] * 12 + [1, 30, 90_000]))
        vol = r.choice([volume] * 10 + [None, max(0, volume - 20)])
        rows.append(snap(seq, ask=99.0 if r.random() < 0.05 else 100.5, volume=vol, ts=ts, symbol=r.choice("AB")))
    got = {x["seq"]: x["reasons"] for x in quality.gate(frame(spark, rows)).collect()}
    late = 0
    for symbol in "AB":
        own = [x for x in rows if x[1] == symbol]
        early = {x["seq"]: list(x["reasons"]) for x in quality.stateless(frame(spark, own)).collect()}
        us = [(x[2] - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) for x in own]
        codes, _ = quality.fold(((u, x[7], not early[x[0]]) for u, x in zip(us, own)), None)
        for x, c in zip(own, codes):
            assert got[x[0]] == early[x[0]] + c, x
        late += sum(map(bool, codes))
    assert late > 50


def test_a_bad_price_stays_in_its_window(spark):
    """NaN and infinity count in no estimator, and what follows is as if the rows weren't there."""
    r = random.Random(4)
    rows = [snap(i, bid=100.0 + 0.5 * r.randint(0, 9), ask=105.0 + 0.5 * r.randint(0, 9), ltp=102.0 + 0.5 * r.randint(0, 9), ltq=r.randint(1, 9), volume=10 * i) for i in range(700)]
    bad = [x if x[0] not in (100, 350) else (*x[:5], float("nan") if x[0] == 100 else float("inf"), *x[6:]) for x in rows]
    names = ["kyle_lambda", "amihud_illiq", "roll_serial_cov", "trade_variance_share"]
    one = {x["seq"]: x for x in est.metrics(flat(spark, bad)).collect()}
    two = {x["seq"]: x for x in est.metrics(flat(spark, [x for x in rows if x[0] not in (100, 350)])).collect()}
    for seq in (99, 101, 349, 351, 500, 699):
        for name in names:
            assert one[seq][name] == pytest.approx(two[seq][name], rel=1e-9, abs=1e-12), (seq, name)
    assert one[100]["kyle_lambda"] is None and one[350]["amihud_illiq"] is None


def test_as_of_agrees_with_brute_force(spark):
    r = random.Random(6)
    left = [(r.choice("AB"), i, r.randint(0, 400)) for i in range(80)] + [("C", 99, 5), ("A", 100, None), (None, 101, None), (None, 102, 3)]
    right = [(k, t, float(t), 5) for k in "AB" for t in sorted(r.sample(range(400), 40))] + [("A", None, 1.0, 9)]
    right += [(k, t, -1.0, 4) for k, t, *_ in right[::3]] + [(k, t, None, 3) for k, t, *_ in right[::5]]  # of one time the row of rank 5 counts
    frames = spark.createDataFrame(left, "symbol string, seq long, t long"), spark.createDataFrame(right, "symbol string, t long, v double, rank int")
    for direction in ("backward", "forward", "nearest"):
        got = {x["seq"]: x["v"] for x in research.as_of(*frames, "t", ["symbol"], ["v"], direction, chunk=50, ties="rank").collect()}
        assert len(got) == len(left)
        for k, seq, t in left:
            if t is None:
                assert got[seq] is None  # kept, without a match
                continue
            own = [u for s, u, *_ in right if s == k and u is not None and (direction != "backward" or u <= t) and (direction != "forward" or u >= t)]
            want = min(own, key=lambda u: (abs(u - t), u > t), default=None)
            assert got[seq] == (None if want is None else float(want)), (direction, k, seq)


def test_as_of_ties_take_the_largest_values(spark):
    left = spark.createDataFrame([("A", 1, 5), ("A", 2, 3)], "symbol string, seq long, t long")
    right = spark.createDataFrame([("A", 4, 1.0, "x"), ("A", 4, 2.0, "a"), ("A", 4, 2.0, "b")], "symbol string, t long, v double, w string")
    for direction, seq in (("backward", 1), ("forward", 2)):
        got = {x["seq"]: (x["v"], x["w"]) for x in research.as_of(left, right, "t", ["symbol"], ["v", "w"], direction).collect()}
        assert got == {seq: (2.0, "b"), 3 - seq: (None, None)}


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_exact_selection_in_passes(spark, monkeypatch, keys):
    """Ranks by narrowing ranges: skewed values, ties, infinities, nulls and small groups; against sorted lists."""
    r = random.Random(7)
    rows = [("A", r.choice([r.gauss(0, 1), 10 ** r.uniform(-300, 300), 5.0])) for _ in range(4000)] + [("B", 7.0)] * 900 + [("B", float("inf")), ("B", -1.0), (None, 3.0), (None, None), ("C", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    monkeypatch.setattr(research, "SORTED", 60)
    monkeypatch.setattr(research, "EDGES", 8)
    shares = {"low": 0.0, "q": 0.123, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {tuple(x[k] for k in keys): x for x in research.quantiles(df, "v", shares, *keys).collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault((k,) if keys else (), []).append(v)
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        assert got[k]["n"] == len(vs)
        for name, p in shares.items():
            at = p * (len(vs) - 1)
            lo, hi = (vs[int(at)], vs[min(len(vs) - 1, int(at) + 1)]) if vs else (None, None)
            if not vs or at == int(at) or lo == hi:
                assert got[k][name] == lo, (k, name)
            else:
                assert got[k][name] == pytest.approx(lo + (at - int(at)) * (hi - lo)), (k, name)


@pytest.mark.parametrize("case", ["future tick", "no volumes"])
def test_gate_settles_what_is_surely_rejected(spark, case):
    """One accepted tick far ahead, or one late tick where no volume is known: later rows are no run for Python."""
    us = list(range(0, 5_000_000_000, 1_000_000))
    if case == "future tick":
        rows = [("A", i, t if i != 10 else 10**12, 10 * i, True) for i, t in enumerate(us)]
    else:
        rows = [("A", i, t if i != 2000 else 5, None, True) for i, t in enumerate(us)]
    known = quality.runs(spark.createDataFrame(rows, "_sym string, seq long, us long, volume long, good boolean"))
    assert known.where("doubtful").count() == 0
