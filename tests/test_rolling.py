"""Estimators over stretches: cut anywhere, their fields are those of the whole series and of plain loops."""

import math
import random

import numpy as np
import pytest

from tidebook.functions import rolling
from tidebook.operators import estimators as est

NAN = math.nan


def series(seed, n=400, odd=0.1):
    """Rows with unknown and infinite prices, one-sided books, falling volumes, days that change and come back."""
    r = random.Random(seed)
    some = lambda x: r.choice([NAN, NAN, math.inf]) if r.random() < odd else x
    day, volume, rows = 5, 0, []
    for _ in range(n):
        day += r.random() < 0.02
        day -= r.random() < 0.005
        volume = 0 if r.random() < 0.02 else volume + r.choice([0, 0, 3, 10])
        bid = 100 + r.randint(0, 4) / 2
        ask = bid + r.randint(1, 3) / 2
        one = r.random() < odd
        rows.append((day, some(102 + r.choice([0, 0, 0.5, -0.5])), NAN if r.random() < odd else r.randint(0, 5), NAN if r.random() < odd else volume, NAN if one else (bid + ask) / 2, some(ask - bid), bid, r.randint(1, 9), NAN if one else ask, r.randint(1, 9)))
    return dict(zip(("day", "ltp", "ltq", "volume", "midprice", "spread", "bid", "bid_qty", "ask", "ask_qty"), np.array(rows, float).T))


def estimators():
    return [
        rolling.Kyle(20, 5), rolling.Amihud(15), rolling.Roll(12, 4), rolling.Share(25, 5), rolling.Flow(), rolling.Rises(), rolling.Session(),
        rolling.Lagged("spread", "lagged", 10), rolling.Scores("spread", "z", 10), rolling.ScoresOf(rolling.Rises(), "z_volume", 10), rolling.ScoresOf(rolling.Flow(), "z_ofi", 10),
    ]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("longest", [1, 3, 60])
def test_stretches_make_the_whole(seed, longest):
    rows = series(seed, odd=[0.0, 0.1, 0.6][seed % 3])
    n, r = len(rows["day"]), random.Random(seed)
    for e in estimators():
        want = e.run(rolling.NONE, rows)
        state, got, at = rolling.NONE, [], 0
        while at < n:
            end = min(n, at + r.randint(1, longest))
            part = {k: v[at:end] for k, v in rows.items()}
            got.append(e.run(state, part))
            state, at = e.join(state, e.part(part)), end
        assert len(state) <= 200
        for name, w, g in zip(e.fields, want, zip(*got)):
            np.testing.assert_allclose(np.concatenate(g), w, rtol=1e-7, atol=2e-6 if name == "vwap_stdev" else 1e-9, err_msg=name)


def test_window_sums():
    r = np.random.default_rng(1)
    for n in (1, 5, 50, 173):
        x = r.normal(size=n)
        for w in (1, 2, 7, 50, 500):
            np.testing.assert_allclose(rolling.last_sums(x, w), [x[max(0, i + 1 - w) : i + 1].sum() for i in range(n)], rtol=1e-12, atol=1e-12)
    assert len(rolling.last_sums(np.zeros(0), 3)) == 0


def test_session_against_a_plain_loop():
    rows = series(3)
    island, dvol, vwap, _, dev, delta = rolling.Session().run(rolling.NONE, rows)
    day = last = price = None
    v = pv = d = side = k = 0
    for i in range(len(island)):
        t, p, x = rows["day"][i], rows["ltp"][i], rows["volume"][i]
        if day is not None and t != day:
            k, last, price, v, pv, d, side = k + 1, None, None, 0, 0, 0, 0
        day = t
        if math.isfinite(p) and not math.isnan(x):
            if last is not None and x < last:
                k, last, price, v, pv, d, side = k + 1, x, None, 0, 0, 0, 0
            traded = x - last if last is not None else 0
            last = x
            if traded > 0:
                side = (side if price is None or p == price else 1 if p > price else -1)
                v, pv, d, price = v + traded, pv + traded * p, d + side * traded, p
            assert dvol[i] == traded
        else:
            assert math.isnan(dvol[i])
        assert island[i] == k and delta[i] == d and (math.isnan(vwap[i]) if not v else vwap[i] == pytest.approx(pv / v))
        assert dev[i] == pytest.approx((p - pv / v) / (pv / v) if v and math.isfinite(p) else 0.0)


def test_scores_against_plain_windows():
    """Unknown and infinite values, first or later, blank their own row alone."""
    r = np.random.default_rng(2)
    for bad in ([0], [0, 1, 40], [100]):
        v = r.normal(5, 2, 300)
        v[bad] = [math.inf, NAN, -math.inf][: len(bad)]
        (z,) = rolling.Scores("spread", "z", 30).run(rolling.NONE, {"spread": v})
        for i in range(len(v)):
            past = v[:i][np.isfinite(v[:i])][-30:]
            if not np.isfinite(v[i]) or len(past) < 5:
                assert math.isnan(z[i])
            else:
                assert z[i] == pytest.approx((v[i] - past.mean()) / past.std())


def test_chunks_of_one_symbol_are_many_tasks(spark, monkeypatch):
    """Small chunks give the fields of one chunk; a symbol alone has as many groups as chunks."""
    cols = "seq long, symbol string, ts timestamp, ltp double, ltq long, volume long, bid_px_1 double, bid_qty_1 long, ask_px_1 double, ask_qty_1 long, midprice double, spread double"
    rows = []
    for symbol, seed in (("A", 5), (None, 6), ("", 7)):
        s = series(seed, 500)
        get = lambda k, i: None if math.isnan(s[k][i]) else float(s[k][i])  # noqa: E731, B023
        whole = lambda k, i: None if math.isnan(s[k][i]) else int(s[k][i])  # noqa: E731, B023
        from datetime import datetime, timedelta, timezone

        for i in range(500):
            ts = datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(days=int(s["day"][i]), seconds=i)
            rows.append((3 * i + seed, symbol, ts, get("ltp", i), whole("ltq", i), whole("volume", i), get("bid", i), whole("bid_qty", i), get("ask", i), whole("ask_qty", i), get("midprice", i), get("spread", i)))
    df = spark.createDataFrame(rows, cols).repartition(5)
    all_of = est.metrics_estimators() | est.score_estimators()
    del all_of["flow"]  # z_ofi gives the events too
    want = est.scan(df, all_of).collect()
    monkeypatch.setattr(est, "BUCKET", 16)
    monkeypatch.setattr(est, "LEAST", 40)
    monkeypatch.setattr(est, "MOST", 60)
    assert est.chunked(df).select("symbol", "_chunk").distinct().count() > 20
    got = {(r["symbol"], r["seq"]): r for r in est.scan(df, all_of).collect()}
    assert len(got) == len(want) == 1500
    for w in want:
        for k, v in w.asDict().items():
            g = got[w["symbol"], w["seq"]][k]
            assert g == (pytest.approx(v, rel=1e-7, abs=2e-6) if isinstance(v, float) and not math.isnan(v) else g if isinstance(v, float) else v), k


def test_flow_by_time_crosses_stretches(spark):
    r = random.Random(9)
    us = sorted(r.sample(range(0, 40_000_000, 500_000), 60)) + [3_000_000, None, None]
    rows = [(i, "A", t, float(r.randint(-9, 9))) for i, t in enumerate(us)]
    df = spark.createDataFrame(rows, "seq long, symbol string, us long, ofi double")
    got = {x["seq"]: x for x in est.flow_sums(df, (2, 7)).collect()}
    assert len(got) == len(rows)
    for i, _, t, _ in rows:
        for w in (2, 7):
            if t is not None:
                assert got[i][f"ofi_{w}s"] == sum(e for *_, u, e in rows if u is not None and t - w * 1_000_000 <= u <= t)


def test_infinite_spreads_leave_later_scores(spark):
    rows = [(i, "A", float("inf") if i in (0, 100) else 0.5 + (i % 7) / 10, 10 * i, 100.0, 1 + i % 3, 101.0, 2) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, symbol string, spread double, volume long, bid_px_1 double, bid_qty_1 long, ask_px_1 double, ask_qty_1 long")
    got = est.zscores(df).collect()
    assert sum(r["z_spread"] is not None for r in got) == 698 - 5 and sum(r["z_ofi"] is not None for r in got) == 695




@pytest.mark.parametrize("seed", range(6))
def test_lagged_scores_against_plain_windows(seed):
    r = random.Random(seed)
    level = [0.0, 1e6][seed % 2]
    v = [r.choice([NAN, math.inf, level, level, level + r.randint(0, 3), level + r.gauss(0, 1)]) for _ in range(300)]
    w = [2, 5, 20][seed % 3]
    want = []
    for i, own in enumerate(v):
        past = [x for x in v[max(0, i - w) : i] if math.isfinite(x)]
        std = np.std(past, ddof=1) if len(past) > 1 and len(set(past)) > 1 else 0.0
        want.append((own - np.mean(past)) / std if std > 1e-12 and math.isfinite(own) else 0.0)
    np.testing.assert_allclose(rolling.Lagged("x", "z", w).run(rolling.NONE, {"x": np.array(v)})[0], want, rtol=1e-4, atol=1e-6)
