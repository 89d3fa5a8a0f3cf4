"""Queries by operator, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import books
from tidebook.operators import estimators as est
from tidebook.plans.ticks import DUCKDB, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Windows of the driver's queries, in seconds: ticks of a symbol are minutes apart in its tables.
HOURS = (3600, 21600, 86400)
TIE = 1.3e-8


def query(name: str, sql: str | None = None, prefix: str = DUCKDB):
    """Register a query on ticks(spark, sf_dir), and its DuckDB SQL, which goes on after the ticks' definition."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = prefix + sql
        return f

    return add


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal; keys as they are.

    What is added beforehand keeps decimal ties from going either way.
    """
    return df.select(*(F.round(F.col(c) + TIE, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c} + {TIE}, {digits}) {c}" for c in columns)


BY = "partition by symbol order by seq"
SO_FAR = f"{BY} rows between unbounded preceding and current row"
BEFORE = f"{BY} rows between unbounded preceding and 1 preceding"
_BOOK = "".join(f", {s}_{w}_{i}" for i in range(1, 6) for s in ("bid", "ask") for w in ("px", "qty"))
_SUM = lambda s, m: " + ".join(m.format(s=s, i=i) for i in range(1, 6))

SPREADS = f""", sp as (select *, (bid_px_1 + ask_px_1) / 2 midprice, ask_px_1 - bid_px_1 spread, (ask_px_1 - bid_px_1) / ((bid_px_1 + ask_px_1) / 2) relative_spread,
  ({_SUM('ask', '{s}_px_{i} * {s}_qty_{i}')}) / ({_SUM('ask', '{s}_qty_{i}')}) - ({_SUM('bid', '{s}_px_{i} * {s}_qty_{i}')}) / ({_SUM('bid', '{s}_qty_{i}')}) weighted_spread from ticks)"""
OFI = f""", of0 as (select *, lag(bid_px_1) over w pb, lag(bid_qty_1) over w pq, lag(ask_px_1) over w pa, lag(ask_qty_1) over w pz from sp window w as ({BY})),
of1 as (select *, cast(case when pb is null then 0 else (case when bid_px_1 > pb then bid_qty_1 when bid_px_1 = pb then bid_qty_1 - pq else -pq end) + (case when ask_px_1 < pa then -ask_qty_1 when ask_px_1 = pa then pz - ask_qty_1 else pz end) end as double) ofi from of0),
of2 as (select *, {', '.join(f'sum(ofi) over (partition by symbol order by us range between {w * 1000000} preceding and current row) ofi_{w}s' for w in HOURS)} from of1)"""
SESSION = f""", se0 as (select *, case when cast(ts as date) <> lag(cast(ts as date)) over ({BY}) then 1 else 0 end turn from of2),
se1 as (select *, sum(turn) over ({SO_FAR}) di from se0),
se2 as (select *, lag(volume) over (partition by symbol, di order by seq) pv from se1),
se3 as (select *, sum(case when volume < pv then 1 else 0 end) over (partition by symbol, di order by seq) vi, case when volume < pv then 0 else coalesce(volume - pv, 0) end dvol from se2),
se4 as (select *, case when dvol > 0 then dvol end v, case when dvol > 0 then ltp end tp from se3),
se5 as (select *, sum(v) over i sv, sum(v * ltp) over i spv, sum(v * ltp * ltp) over i sppv, last_value(tp ignore nulls) over (partition by symbol, di, vi order by seq rows between unbounded preceding and 1 preceding) ptp from se4 window i as (partition by symbol, di, vi order by seq)),
se6 as (select *, spv / sv vwap, sqrt(greatest(0, sppv / sv - (spv / sv) * (spv / sv))) vwap_stdev, case when tp > ptp then 1 when tp < ptp then -1 end mv from se5),
se7 as (select *, case when dvol > 0 then coalesce(last_value(mv ignore nulls) over (partition by symbol, di, vi order by seq rows between unbounded preceding and current row), 0) end side from se6),
se as (select * replace (case when vwap is not null then vwap_stdev end as vwap_stdev), coalesce((ltp - vwap) / vwap, 0.0) vwap_dev, cast(coalesce(sum(side * dvol) over (partition by symbol, di, vi order by seq), 0) as bigint) cum_delta from se7)"""
IMPACT = f""", im0 as (select *, lag(midprice) over w pm, lag(ltp) over w pp from se window w as ({BY})),
im1 as (select *, case when ltp > pp then 1 when ltp < pp then -1 end tm, row_number() over ({BY}) rn from im0),
im2 as (select *, coalesce(last_value(tm ignore nulls) over ({SO_FAR}), 0) sgn, ltp - pp d, (midprice - pm) / pm * 1e4 y, (ltp - pp) / pp * 1e4 tr from im1),
im3 as (select *, case when y is not null then cast(sgn * ltq as double) end x, lag(d) over ({BY}) pd, abs(midprice - pm) / pm * 1e4 / (ltp * ltq) * 1e6 ar from im2),
im4 as (select *, regr_sxx(y, x) over a sxx, regr_sxy(y, x) over a sxy, regr_syy(y, x) over a syy, count(y) over a n, avg(ar) over a am, covar_pop(d, pd) over r cv, count(pd) over r rc,
  var_pop(tr) over v vt, var_pop(y) over v vq, avg(sgn * tr) over v sa, count(y) over v vc from im3
  window a as ({BY} rows between 299 preceding and current row), r as ({BY} rows between 199 preceding and current row), v as ({BY} rows between 499 preceding and current row)),
im as (select *, case when n >= 30 then case when sxx < 1e-12 then 0.0 else sxy / sxx end end kyle_lambda,
  case when n >= 30 then case when sxx < 1e-12 or syy <= 0 then 0.0 else greatest(0, 1 - greatest(0, syy - sxy / sxx * sxy) / syy) end end kyle_r2,
  case when n >= 30 then case when sxx < 1e-12 or syy - sxy / sxx * sxy <= 0 then 0.0 else sxy / sxx / sqrt(greatest(0, syy - sxy / sxx * sxy) / (n - 2) / sxx) end end kyle_t_stat,
  case when ar is not null then am end amihud_illiq, case when pd is not null and rc >= 30 then cv end roll_serial_cov,
  case when pd is not null and rc >= 30 then case when cv < 0 then 2 * sqrt(-cv) else 0.0 end / midprice * 1e4 end roll_spread_bps,
  case when vc >= 50 and y is not null then case when vt + vq > 0 then vt / (vt + vq) else 0.5 end end trade_variance_share, case when vc >= 50 and y is not null then sa end avg_signed_trade_return_bps from im4)"""
Z = f""", z0 as (select *, greatest(0, coalesce(volume - lag(volume) over ({BY}), 0)) tick_volume from of2),
z1 as (select *, {', '.join(f'count({v}) over w n_{n}, avg({v}) over w m_{n}, stddev_pop({v}) over w s_{n}' for v, n in (('spread', 'spread'), ('tick_volume', 'volume'), ('ofi', 'ofi')))} from z0 window w as ({BY} rows between 300 preceding and 1 preceding)),
z as (select *, {', '.join(f'case when n_{n} >= 5 and s_{n} >= 1e-9 then ({v} - m_{n}) / s_{n} end z_{n}' for v, n in (('spread', 'spread'), ('tick_volume', 'volume'), ('ofi', 'ofi')))} from z1)"""
CHAIN = SPREADS + OFI + SESSION + IMPACT

# projections and spreads
query("src7_ticks", f" select seq, us, symbol, ltp, ltq, volume{_BOOK} from ticks")(lambda s, d: ticks(s, d).drop("ts"))
query("p1_flatten_book", f" select seq, symbol{_BOOK} from ticks")(lambda s, d: books.flatten(books.nest(ticks(s, d).select("seq", "symbol", *(f.strip() for f in _BOOK.split(",") if f.strip())))))
query("p2_nested_book", " select seq, symbol, 5 n_bids, bid_px_1 + bid_px_5 ends, bid_qty_1 + ask_qty_5 sizes from ticks")(
    lambda s, d: books.nest(ticks(s, d)).select("seq", "symbol", F.size("bids").alias("n_bids"), (F.col("bids")[0]["price"] + F.element_at("bids", -1)["price"]).alias("ends"), (F.col("bids")[0]["qty"] + F.element_at("asks", -1)["qty"]).alias("sizes"))
)
_side = lambda s: "[" + ", ".join(f"{{'price': {s}_px_{i}, 'qty': {s}_qty_{i}, 'orders': 0}}" for i in range(1, 6)) + "]"
_json = f"to_json({{'symbol': symbol, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', 'bids': {_side('bid')}, 'asks': {_side('ask')}, 'ltp': ltp, 'ltq': ltq, 'volume': volume}})"
query("p3_snapshot_json", f" select symbol, seq, cast({_json} as varchar) json from ticks")(lambda s, d: books.snapshot_json(books.nest(ticks(s, d))))
for _name, _col in (("p5_quoted_spread", "spread"), ("p6_relative_spread", "relative_spread"), ("p7_weighted_spread", "weighted_spread"), ("p8_midprice", "midprice")):
    query(_name, f"{SPREADS} select seq, symbol, {_r(_col)} from sp")(lambda s, d, c=_col: rounded(books.spreads(ticks(s, d)).select("seq", "symbol", c)))
query("p9_vwap_dev", f"{SPREADS}{OFI}{SESSION} select seq, symbol, {_r('vwap_dev')} from se")(lambda s, d: rounded(est.sessions(ticks(s, d)).select("seq", "symbol", "vwap_dev")))
query("p10_symbol_filter", " select seq, symbol, ltp from ticks where symbol = 'PURCHASE'")(lambda s, d: ticks(s, d).where("symbol = 'PURCHASE'").select("seq", "symbol", "ltp"))
query("p13_symbol_repair", " select seq, upper(trim('  ' || lower(symbol) || ' ')) symbol from ticks")(lambda s, d: ticks(s, d).select("seq", F.upper(F.trim(F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")))).alias("symbol")))
query("p17_column_subset", " select volume, symbol, seq from ticks")(lambda s, d: ticks(s, d).select("volume", "symbol", "seq"))
query("p18_unit_scaling", f"{SPREADS} select seq, round(relative_spread * 1e4 + 1.3e-8, 6) spread_bps, round(relative_spread * 100 + 1.3e-8, 6) spread_pct from sp")(
    lambda s, d: rounded(books.spreads(ticks(s, d)).select("seq", (F.col("relative_spread") * 1e4).alias("spread_bps"), (F.col("relative_spread") * 100).alias("spread_pct")))
)
query("p19_vwap_band", f"{SPREADS}{OFI}{SESSION} select seq, symbol, round(vwap - vwap_stdev + 1.3e-8, 6) low, round(vwap + vwap_stdev + 1.3e-8, 6) high from se")(
    lambda s, d: rounded(est.sessions(ticks(s, d)).select("seq", "symbol", (F.col("vwap") - F.col("vwap_stdev")).alias("low"), (F.col("vwap") + F.col("vwap_stdev")).alias("high")))
)
_share = ", ".join(f"{s}_qty_{i}" for i in range(1, 6) for s in ("bid", "ask"))
query("p20_depth_share", " " + " union all ".join(f"select symbol, seq, '{s}' side, {i} as level, round({s}_qty_{i} / greatest(1, {_share})::double + 1.3e-8, 6) share from ticks" for i in range(1, 6) for s in ("bid", "ask")))(
    lambda s, d: rounded(books.depth_share(ticks(s, d)))
)
query("p21_signed_split", f"{SPREADS}{OFI} select seq, case when ofi >= 0 then ofi end ofi_pos, case when ofi < 0 then ofi end ofi_neg from of2")(
    lambda s, d: books.signed_split(est.order_flow(ticks(s, d), ()), "ofi").select("seq", "ofi_pos", "ofi_neg")
)

# windows
query("w1_ofi_event", f"{SPREADS}{OFI} select seq, symbol, ofi from of2")(lambda s, d: est.order_flow(ticks(s, d), ()).select("seq", "symbol", "ofi"))
query("w2_ofi_rolling", f"{SPREADS}{OFI} select seq, symbol, {', '.join(f'ofi_{w}s' for w in HOURS)} from of2")(lambda s, d: est.order_flow(ticks(s, d), HOURS).select("seq", "symbol", *(f"ofi_{w}s" for w in HOURS)))
query("w3_tick_rule", f"{CHAIN} select seq, symbol, sgn from im")(lambda s, d: est.tick_rule(ticks(s, d), "sgn", F.col("ltp").isNotNull()).select("seq", "symbol", "sgn"))
query("w4_session_vwap", f"{SPREADS}{OFI}{SESSION} select seq, symbol, {_r('vwap', 'vwap_stdev', digits=5)} from se")(lambda s, d: rounded(est.sessions(ticks(s, d)).select("seq", "symbol", "vwap", "vwap_stdev"), digits=5))
query("w5_cumulative_delta", f"{SPREADS}{OFI}{SESSION} select seq, symbol, cum_delta from se")(lambda s, d: est.sessions(ticks(s, d)).select("seq", "symbol", "cum_delta"))
for _name, _f, _cols in (
    ("w6_kyle_lambda", est.kyle, ("kyle_lambda", "kyle_r2", "kyle_t_stat")),
    ("w7_amihud", est.amihud, ("amihud_illiq",)),
    ("w8_roll_spread", est.roll, ("roll_serial_cov", "roll_spread_bps")),
    ("w9_variance_share", est.variance_share, ("trade_variance_share", "avg_signed_trade_return_bps")),
):
    _n = 3 if _f is est.amihud else 6  # its values are in the hundred thousands
    query(_name, f"{CHAIN} select seq, symbol, {_r(*_cols, digits=_n)} from im")(lambda s, d, f=_f, c=_cols, n=_n: rounded(f(books.spreads(ticks(s, d))).select("seq", "symbol", *c), digits=n))
query("w10_zscores", f"{SPREADS}{OFI}{Z} select seq, symbol, {_r('z_spread', 'z_volume', 'z_ofi')} from z")(lambda s, d: rounded(est.zscores(books.spreads(ticks(s, d))).select("seq", "symbol", "z_spread", "z_volume", "z_ofi")))
_alerts = " union all ".join(
    f"select symbol, seq, {i} place, '{k}' kind, case when abs(z_{n}) < 3 then 'warn' else 'critical' end severity, round(z_{n}, 2) zscore from z where {c}" for i, (k, n, c) in enumerate((("spread_blowup", "spread", "z_spread > 2"), ("volume_spike", "volume", "z_volume > 2"), ("ofi_extreme", "ofi", "abs(z_ofi) > 2")))
)
ALERTS = f"{SPREADS}{OFI}{Z}, al as ({_alerts})"


def alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts at two deviations, which these tables have."""
    return est.anomalies(books.spreads(ticks(s, d)), threshold=2.0).withColumn("zscore", F.col("detail")["zscore"])


query("w11_anomalies", f"{ALERTS} select symbol, seq, place, kind, severity, zscore from al")(lambda s, d: alerts(s, d).select("symbol", "seq", "place", "kind", "severity", "zscore"))
query("w21_tick_volume", f"{SPREADS}{OFI}{Z} select seq, symbol, tick_volume from z")(lambda s, d: est.tick_volume(ticks(s, d)).select("seq", "symbol", "tick_volume"))
METRICS = ["ltp", "midprice", "spread", "relative_spread", "weighted_spread", *(f"ofi_{w}s" for w in HOURS), "vwap", "vwap_dev", "vwap_stdev", "cum_delta", "kyle_lambda", "kyle_r2", "kyle_t_stat", "amihud_illiq", "roll_spread_bps", "roll_serial_cov", "trade_variance_share", "avg_signed_trade_return_bps"]
query("metrics", f"{CHAIN} select seq, us, symbol, {', '.join(c if c in ('ltp', 'cum_delta') else f'round({c} + {TIE}, {2 if c == "amihud_illiq" else 5}) {c}' for c in METRICS)} from im")(
    lambda s, d: rounded(est.metrics(ticks(s, d), HOURS).drop("timestamp"), "ltp", "amihud_illiq", digits=5).withColumn("amihud_illiq", F.round(F.col("amihud_illiq") + TIE, 2))
)
query("a1_volume_profile", f"{SPREADS}{OFI}{SESSION} select symbol, bucket, cast(sum(dvol) as bigint) qty from (select *, round(floor(ltp / 0.5) * 0.5, 4) bucket from se where dvol > 0) t join (select symbol, max(di) di from se group by symbol) m using (symbol, di) group by all")(
    lambda s, d: est.volume_profile(ticks(s, d))
)
