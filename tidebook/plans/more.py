"""Further queries: gate, research, backtest, execution, histories, sources; the same in DuckDB SQL where it can say it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import alerts as al
from tidebook.operators import backtest as bt
from tidebook.operators import books, execution, quality, research
from tidebook.operators import estimators as est
from tidebook.plans.catalog import ALERTS, BY, CHAIN, HOURS, OFI, QUERIES, SPREADS, SQL, TIE, alerts, query, rounded
from tidebook.plans.ticks import ticks
from tidebook.schema import MODULES
from tidebook.sources import reports, store, synthetic

SYMBOLS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")
R = lambda x, d=6: f"round({x} + {TIE}, {d})"


def spreads(s: SparkSession, d: str) -> DataFrame:
    return books.spreads(ticks(s, d))


def flow(s: SparkSession, d: str) -> DataFrame:
    return est.order_flow(spreads(s, d), HOURS)


# the gate, on ticks of which some are spoilt
def spoilt(s: SparkSession, d: str) -> DataFrame:
    """Snapshots: every 97th book locked, every 101st without a number as price, every 103rd symbol unclean, every 107th without volume."""
    t = ticks(s, d)
    t = t.withColumns(
        {
            "ask_px_1": F.when(F.col("seq") % 97 == 0, F.col("bid_px_1")).otherwise(F.col("ask_px_1")),
            "ltp": F.when(F.col("seq") % 101 == 0, F.lit(float("nan"))).otherwise(F.col("ltp")),
            "symbol": F.when(F.col("seq") % 103 == 0, F.concat(F.lit(" "), F.lower("symbol"))).otherwise(F.col("symbol")),
            "volume": F.when(F.col("seq") % 107 == 0, F.lit(None)).otherwise(F.col("volume")),
            "ts": F.when(F.col("seq") % 89 == 0, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts")),
        }
    )
    return books.nest(t)


# locked books keep ask1 at bid1, which is still ascending
_CODES = """, sp0 as (select seq, us - case when seq % 89 = 0 then 259200000000 else 0 end us, symbol, case when seq % 107 = 0 then null else volume end volume, seq % 97 = 0 locked, seq % 101 = 0 nan, seq % 103 = 0 dirty from ticks),
rw as (select *, row_number() over (partition by symbol order by seq) rn from sp0),
gate as (select seq, us, symbol, volume, locked, nan, dirty, rn, false late, false falls, case when not locked and not nan then us end last_us, case when not locked and not nan then volume end last_volume from rw where rn = 1
 union all select r.seq, r.us, r.symbol, r.volume, r.locked, r.nan, r.dirty, r.rn, coalesce(r.us <= g.last_us, false), coalesce(r.us // 86400000000 = g.last_us // 86400000000 and r.volume < g.last_volume, false),
  case when not r.locked and not r.nan and not coalesce(r.us <= g.last_us, false) and not coalesce(r.us // 86400000000 = g.last_us // 86400000000 and r.volume < g.last_volume, false) then r.us else g.last_us end,
  case when not r.locked and not r.nan and not coalesce(r.us <= g.last_us, false) and not coalesce(r.us // 86400000000 = g.last_us // 86400000000 and r.volume < g.last_volume, false) then coalesce(r.volume, g.last_volume) else g.last_volume end
 from gate g join rw r on r.symbol = g.symbol and r.rn = g.rn + 1),
codes as (select seq, symbol, dirty, concat_ws(',', case when locked then 'crossed_or_locked_book' end, case when nan then 'invalid_ltp' end, case when late then 'non_monotonic_timestamp' end, case when falls then 'cumulative_volume_decrease' end) codes from gate)"""
query("p14_stateless_codes", """, c as (select seq, symbol, concat_ws(',', case when seq % 97 = 0 then 'crossed_or_locked_book' end, case when seq % 101 = 0 then 'invalid_ltp' end) codes, seq % 103 = 0 repaired from ticks)
 select * from c""")(lambda s, d: quality.stateless(spoilt(s, d)).select("seq", "symbol", F.array_join("reasons", ",").alias("codes"), (F.size("repaired_fields") > 0).alias("repaired")))
def faulty(s: SparkSession, d: str) -> DataFrame:
    """Snapshots with every fault that a single tick can have, each at the multiples of a prime."""
    t = ticks(s, d)
    at = lambda n, value, column: F.when(F.col("seq") % n == 0, value).otherwise(F.col(column))
    t = t.withColumns(
        {
            "bid_px_1": at(83, F.col("bid_px_2"), "bid_px_1"), "bid_px_2": at(83, F.col("bid_px_1"), "bid_px_2"), "ask_px_2": at(79, F.col("ask_px_3"), "ask_px_2"), "ask_px_3": at(79, F.col("ask_px_2"), "ask_px_3"),
            "ask_px_1": at(97, F.col("bid_px_1"), "ask_px_1"), "ask_qty_3": at(137, F.lit(0), "ask_qty_3"), "ltp": at(101, F.lit(float("inf")), "ltp"), "ltq": at(139, F.lit(-1), "ltq"), "volume": at(149, F.lit(-1), "volume"),
            "symbol": F.when(F.col("seq") % 109 == 0, F.lit(None)).otherwise(at(113, F.lit("  "), "symbol")), "ts": at(127, F.lit(None), "ts"),
        }
    )
    return books.nest(t).withColumn("bids", F.when(F.col("seq") % 131 == 0, F.array().cast("array<struct<price:double,qty:bigint,orders:int>>")).otherwise(F.col("bids")))


_FAULT = lambda n: f"seq % {n} = 0"
_FAULTS = {
    "invalid_symbol": _FAULT(109), "empty_symbol": f"not {_FAULT(109)} and {_FAULT(113)}", "unknown_symbol": f"not {_FAULT(109)} and not {_FAULT(113)} and symbol = 'ERROR'", "invalid_timestamp": _FAULT(127), "invalid_book_depth": _FAULT(131),
    "invalid_book_level": _FAULT(137), "bids_not_descending": f"{_FAULT(83)} and not {_FAULT(131)} and not {_FAULT(137)}", "asks_not_ascending": f"{_FAULT(79)} and not {_FAULT(137)}",
    "crossed_or_locked_book": f"{_FAULT(97)} and not {_FAULT(83)} and not {_FAULT(131)} and not {_FAULT(137)}", "invalid_ltp": _FAULT(101), "invalid_ltq": _FAULT(139), "invalid_volume": _FAULT(149),
}
query("p14_all_codes", f" select seq, concat_ws(',', {', '.join(f"case when {c} then '{k}' end" for k, c in _FAULTS.items())}) codes from ticks")(
    lambda s, d: quality.stateless(faulty(s, d), tuple(k for k in SYMBOLS if k != "ERROR")).select("seq", F.array_join("reasons", ",").alias("codes"))
)
query("p15_book_order", f" select seq, {_FAULTS['bids_not_descending']} bids_wrong, {_FAULTS['asks_not_ascending']} asks_wrong from ticks")(
    lambda s, d: quality.stateless(faulty(s, d)).select("seq", F.array_contains("reasons", "bids_not_descending").alias("bids_wrong"), F.array_contains("reasons", "asks_not_ascending").alias("asks_wrong"))
)
query("w20_sequential_gate", f"{_CODES} select seq, symbol, codes, codes = '' accepted from codes")(lambda s, d: quality.gate(spoilt(s, d)).select("seq", "symbol", F.array_join("reasons", ",").alias("codes"), "accepted"))
query("a25_reason_counts", f"{_CODES} select unnest(string_split(codes, ',')) reason, count(*) n from codes where codes <> '' group by 1")(lambda s, d: quality.reason_counts(quality.gate(spoilt(s, d))))
query("a25_gate_counters", f"{_CODES} select count(*) received, count(*) filter (codes = '') accepted, count(*) filter (codes <> '') rejected, count(*) filter (codes = '' and dirty) repaired from codes")(lambda s, d: quality.counters(quality.gate(spoilt(s, d))))
query("snk3_quarantine", f"{_CODES} select codes rejection_reasons, seq from codes where codes <> ''")(lambda s, d: quality.quarantine(quality.gate(spoilt(s, d))).select(F.array_join("rejection_reasons", ",").alias("rejection_reasons"), F.col("snapshot.seq").alias("seq")))
query("j7_allowed_symbols", " select seq, symbol, symbol in ('CLICK', 'VIEW') allowed from ticks")(lambda s, d: quality.stateless(books.nest(ticks(s, d)), ("CLICK", "VIEW")).select("seq", "symbol", (~F.array_contains("reasons", "unknown_symbol")).alias("allowed")))

# aggregations
query("a2_group_mean", f"{SPREADS} select symbol, {R('avg(spread)')} spread, {R('avg(weighted_spread)')} weighted_spread from sp group by symbol")(lambda s, d: rounded(spreads(s, d).groupBy("symbol").agg(F.avg("spread").alias("spread"), F.avg("weighted_spread").alias("weighted_spread"))))
query("a3_describe", f"{SPREADS} select symbol, count(spread) as count, {R('avg(spread)')} mean, {R('stddev_samp(spread)')} std, {R('min(spread)')} min, {R('quantile_cont(spread, 0.25)')} q25, {R('quantile_cont(spread, 0.5)')} q50, {R('quantile_cont(spread, 0.75)')} q75, {R('max(spread)')} max from sp group by symbol")(
    lambda s, d: rounded(research.describe(spreads(s, d), "spread", "symbol"))
)
query("a4_group_size", " select symbol, count(*) n from ticks group by symbol")(lambda s, d: ticks(s, d).groupBy("symbol").agg(F.count("*").alias("n")))
query("a5_value_counts", f"{ALERTS} select kind, symbol, count(*) n from al group by all")(lambda s, d: research.value_counts(alerts(s, d), "kind", "symbol"))
query("a6_first_seen", " select symbol, min(seq) first_seq from ticks group by symbol")(lambda s, d: research.first_seen(ticks(s, d)))
query("a7_cut_bins", " , m as (select symbol, min(ltp) lo, (max(ltp) - min(ltp)) / 40 w from ticks group by symbol) select symbol, cast(greatest(1, least(40, ceil((ltp - lo) / w))) as bigint) bin, cast(sum(ltq) as bigint) total from ticks join m using (symbol) group by all")(
    lambda s, d: research.cut(ticks(s, d), "ltp", 40, "ltq")
)
query("a8_histogram", f"{SPREADS}, m as (select symbol, min(relative_spread) lo, (max(relative_spread) - min(relative_spread)) / 60 w, count(*) c from sp group by symbol) select symbol, cast(least(59, floor((relative_spread - lo) / w)) as bigint) bin, count(*) n, {R('count(*) / (max(c) * max(w))')} density from sp join m using (symbol) group by all")(
    lambda s, d: rounded(research.histogram(spreads(s, d), "relative_spread", 60))
)
query("a9_percentiles", " select symbol, " + ", ".join(f"{R(f'quantile_cont(ltp, 0.{p})')} p{p}" for p in (50, 95, 99)) + " from ticks group by symbol")(
    lambda s, d: rounded(research.quantiles(ticks(s, d), "ltp", {f"p{p}": p / 100 for p in (50, 95, 99)}, "symbol").drop("n"))
)


def timings(s: SparkSession, d: str) -> DataFrame:
    """A table of timings by rule: module m takes 1 + (seq * (m + 3)) % 97 microseconds."""
    return ticks(s, d).select(F.col("seq").alias("tick_id"), "symbol", *((F.col("seq") * (i + 3) % 97 + 1).cast("double").alias(f"{m}_us") for i, m in enumerate(MODULES)))


_LONG = ", lg as (" + " union all ".join(f"select '{m}_us' as module, cast(seq * {i + 3} % 97 + 1 as double) us from ticks" for i, m in enumerate(MODULES)) + ")"
query("a10_timing_block", f"{_LONG}, g as (select module, avg(us) mean, quantile_cont(us, 0.5) p50, quantile_cont(us, 0.95) p95, quantile_cont(us, 0.99) p99, max(us) max, min(us) min, stddev_pop(us) std from lg group by module) select module, {', '.join(f'{R(c)} {c}' for c in ('mean', 'p50', 'p95', 'p99', 'max', 'min', 'std'))}, {R('mean / sum(mean) over () * 100')} share_pct from g")(
    lambda s, d: rounded(research.timing_block(research.unpivot(timings(s, d), [], [f"{m}_us" for m in MODULES])))
)
SQL["a11_module_share"] = f"select module, share_pct from ({SQL['a10_timing_block']})"
QUERIES["a11_module_share"] = lambda s, d: QUERIES["a10_timing_block"](s, d).select("module", "share_pct")
query("a12_boxplot", f", q as (select symbol, quantile_cont(ltp, 0.25) q1, quantile_cont(ltp, 0.5) median, quantile_cont(ltp, 0.75) q3 from ticks group by symbol) select symbol, {R('q1')} q1, {R('median')} median, {R('q3')} q3, {R('min(ltp)')} low, {R('max(ltp)')} high from ticks join q using (symbol) where ltp between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by symbol, q1, median, q3")(
    lambda s, d: rounded(research.boxplot(ticks(s, d), "ltp", "symbol"))
)
RET = f"{SPREADS}, rt as (select seq, symbol, ltp, midprice, spread, volume, midprice / lag(midprice) over ({BY}) - 1 ret, lead(midprice, 5) over ({BY}) / midprice - 1 fwd from sp)"


def returns(s: SparkSession, d: str) -> DataFrame:
    return spreads(s, d).withColumns({"ret": research.pct_change("midprice"), "fwd": research.forward_return("midprice")})


query("a13_moments", f"{RET} select symbol, {R('skewness(ret)')} skew, {R('kurtosis(ret)')} kurtosis from rt group by symbol")(lambda s, d: rounded(research.moments(returns(s, d), "ret", "symbol")))
query("a14_correlation", f"{SPREADS}{OFI}, f as (select *, lead(midprice, 5) over ({BY}) / midprice - 1 fwd from of2) select symbol, count(*) n, {R('corr(ofi, fwd)')} corr from f where fwd is not null group by symbol having count(*) > 30")(
    lambda s, d: rounded(research.correlation(flow(s, d).withColumn("fwd", research.forward_return("midprice")), "ofi", "fwd", "symbol").drop("p_value"))
)
query("a14_p_value")(lambda s, d: research.correlation(flow(s, d).withColumn("fwd", research.forward_return("midprice")), "ofi", "fwd", "symbol"))
_M = ["spread", "relative_spread", "weighted_spread", "ofi", "ltq", "ltp", "midprice"]
_pairs = [(a, b) for i, a in enumerate(_M) for b in _M[i + 1 :]]
query("a15_correlation_matrix", f"{SPREADS}{OFI} " + " union all ".join(f"select '{a}' a, '{b}' b, {R(f'corr({a}, {b})')} corr from of2" for a, b in _pairs))(lambda s, d: rounded(research.correlation_matrix(flow(s, d), _M)))
query("a16_trend", f"{SPREADS} select symbol, regr_count(spread, ltq) n, {R('regr_slope(spread, ltq)')} slope, {R('regr_intercept(spread, ltq)')} intercept, {R('regr_r2(spread, ltq)')} r2 from sp group by symbol")(lambda s, d: rounded(research.trend(spreads(s, d), "ltq", "spread", "symbol").drop("p_value")))
query("a17_line", f"{SPREADS} select symbol, regr_count(spread, ltq) n, {R('regr_slope(spread, ltq)', 9)} slope, {R('regr_intercept(spread, ltq)')} intercept, {R('regr_r2(spread, ltq)', 9)} r2 from sp group by symbol")(
    lambda s, d: research.trend(spreads(s, d), "ltq", "spread", "symbol").select("symbol", "n", *(F.round(F.col(c) + TIE, k).alias(c) for c, k in (("slope", 9), ("intercept", 6), ("r2", 9))))
)
query("a17_linregress")(lambda s, d: research.trend(spreads(s, d), "ltq", "spread", "symbol"))
query("a18_autocorrelation", f"{RET}, z as (select *, avg(ret) over (partition by symbol) m, count(*) over (partition by symbol) c from rt where ret is not null and ret <> 0), y as (select *, ret - m d, {', '.join(f'lag(ret - m, {k}) over ({BY}) l{k}' for k in range(1, 41))} from z where c > 100) " + " union all ".join(f"select symbol, {k} as lag, {R(f'sum(d * l{k}) / sum(d * d)')} acf from y group by symbol" for k in range(1, 41)))(
    lambda s, d: rounded(research.autocorrelation(returns(s, d), "ret").drop("band"))
)
query("a27_pivot", ", p as (select cast(ts as date) as day, symbol, count(*) n from ticks group by all) select cast(day as varchar) as day, " + ", ".join(f"cast(coalesce(sum(n) filter (symbol = '{k}'), 0) as bigint) {k.lower()}" for k in SYMBOLS) + " from p group by day")(
    lambda s, d: ticks(s, d).groupBy(F.to_date("ts").cast("string").alias("day")).pivot("symbol", list(SYMBOLS)).agg(F.count(F.lit(1))).select("day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in SYMBOLS))
)
query("a28_load_summary", f" select count(*) messages, {R('avg(case when ltq > 5 then 1.0 else 0.0 end)')} success_rate, {R('avg(ltp)')} mean, {R('list_sort(list(ltp))[cast(floor(count(*) * 0.99) as bigint) + 1]')} p99 from ticks")(lambda s, d: rounded(research.load_summary(ticks(s, d), "ltp", F.col("ltq") > 5)))

# windows and joins of the research notebooks
query("w13_volume_change", f" select seq, cast(greatest(0, coalesce(volume - lag(volume) over ({BY}), 0)) as bigint) dv from ticks")(lambda s, d: ticks(s, d).select("seq", F.greatest(F.lit(0), F.coalesce(F.col("volume") - F.lag("volume").over(est.by()), F.lit(0))).cast("long").alias("dv")))
query("w14_pct_change", f"{RET} select seq, {R('ret', 8)} ret from rt")(lambda s, d: rounded(returns(s, d).select("seq", "ret"), digits=8))
query("w15_forward_return", f"{RET} select seq, {R('fwd', 8)} fwd from rt")(lambda s, d: rounded(returns(s, d).select("seq", "fwd"), digits=8))
query("w16_rolling_mean", f"{SPREADS} select seq, symbol, {R(f'case when count(spread) over (m) = 50 then avg(spread) over (m) end'.replace('(m)', 'm'))} spread_ma, {R('case when count(volume) over m = 50 then avg(volume) over m end')} vol_ma from sp window m as ({BY} rows between 49 preceding and current row)")(
    lambda s, d: rounded(spreads(s, d).select("seq", "symbol", research.rolling_mean("spread", 50).alias("spread_ma"), research.rolling_mean("volume", 50).alias("vol_ma")))
)
query("w17_running_index", f" select seq, symbol, cast(row_number() over ({BY}) - 1 as integer) tick from ticks")(lambda s, d: ticks(s, d).select("seq", "symbol", (F.row_number().over(est.by()) - 1).alias("tick")))
query("w18_running_max", f" select seq, symbol, max(ltp) over ({BY}) high from ticks")(lambda s, d: ticks(s, d).select("seq", "symbol", F.max("ltp").over(est.so_far()).alias("high")))
query("w19_prefix_sum", f" select seq, symbol, cast(sum(ltq) over ({BY}) as bigint) total from ticks")(lambda s, d: ticks(s, d).select("seq", "symbol", F.sum("ltq").over(est.so_far()).cast("long").alias("total")))
_asof = """, l as (select seq, symbol, us + 1000000 * (seq % 7) us from ticks), r as (select symbol, us rus, ltp from ticks),
b as (select l.seq, l.symbol, l.us, r.rus brus, r.ltp bltp from l asof left join r on l.symbol = r.symbol and l.us >= r.rus), f as (select l.seq, r.rus frus, r.ltp fltp from l asof left join r on l.symbol = r.symbol and l.us <= r.rus)"""


def asof(s: SparkSession, d: str, direction: str) -> DataFrame:
    """Every tick, later by 0 to 6 seconds, with all ticks of its symbol."""
    t = ticks(s, d)
    left = t.select("seq", "symbol", (F.col("us") + 1_000_000 * (F.col("seq") % 7)).alias("us"))
    return research.as_of(left, t.select("symbol", "us", "ltp"), "us", ["symbol"], ["ltp"], direction)


def ragged_asof(s: SparkSession, d: str, direction: str) -> DataFrame:
    """Every tick, one in 97 without a time, with all ticks at whole hours, of which the last of its hour counts."""
    t = ticks(s, d)
    left = t.select("seq", "symbol", F.when(F.col("seq") % 97 > 0, F.col("us")).alias("us"))
    hours = t.select("symbol", (F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000).alias("us"), "ltp", "seq")
    return research.as_of(left, hours, "us", ["symbol"], ["ltp"], direction, ties="seq").drop("us")


_ragged = """, l as (select seq, symbol, case when seq % 97 > 0 then us end us from ticks), r as (select symbol, us // 3600000000 * 3600000000 rus, max_by(ltp, seq) ltp from ticks group by all),
b as (select l.seq, l.symbol, l.us, r.rus brus, r.ltp bltp from l asof left join r on l.symbol = r.symbol and l.us >= r.rus), f as (select l.seq, r.rus frus, r.ltp fltp from l asof left join r on l.symbol = r.symbol and l.us <= r.rus)"""
for _name, _from, _how, _us in (("asof", _asof, asof, ", us"), ("whole", _ragged, ragged_asof, "")):
    query(f"j1_{_name}_nearest", f"{_from} select seq, symbol{_us}, case when frus is null or us - brus <= frus - us then bltp else fltp end ltp from b join f using (seq)")(lambda s, d, f=_how: f(s, d, "nearest"))
    query(f"j1_{_name}_backward", f"{_from} select seq, symbol{_us}, bltp ltp from b")(lambda s, d, f=_how: f(s, d, "backward"))
    query(f"j1_{_name}_forward", f"{_from} select seq, symbol{_us}, fltp ltp from b join f using (seq)")(lambda s, d, f=_how: f(s, d, "forward"))
query("j2_positional_join", f"{SPREADS} select seq, symbol, {R('spread')} spread, volume from sp")(lambda s, d: rounded(research.aligned(spreads(s, d).select("seq", "symbol", "spread"), ticks(s, d).select("seq", "symbol", "volume"))))
def symbol_grid(s: SparkSession, d: str) -> DataFrame:
    """Every symbol of the ticks with every candidate of the grid."""
    grid = F.array(*(F.struct(F.lit(i).alias("cand"), F.lit(e).alias("entry"), F.lit(x).alias("exit"), F.lit(n).alias("lookback")) for i, (e, x, n) in enumerate(bt.GRID)))
    return ticks(s, d).select("symbol").distinct().select("symbol", F.inline(grid))


QUERIES["j3_parameter_grid"] = symbol_grid
SQL["j3_parameter_grid"] = "select upper(event_type) symbol, g.* from (select distinct event_type from events), (select cast(row_number() over (order by e, x, n) - 1 as integer) cand, e entry, x exit, n lookback from (values (1.25::double), (1.5), (2.0)) a(e), (values (0.2::double), (0.4)) b(x), (values (50::integer), (100)) c(n)) g"

# backtest, walk-forward
_Z = lambda n, part="symbol": f"coalesce(case when count(s) over w >= 2 and stddev_samp(s) over w > 1e-12 then (s - avg(s) over w) / stddev_samp(s) over w end, 0.0)"
STRATEGY = bt.Strategy(lookback=50, entry=1.25, exit=0.4)
BACK = f"""{SPREADS}{OFI}, bs as (select symbol, seq, midprice price, ofi_86400s s from of2),
bz as (select *, {_Z(50)} z from bs window w as ({BY} rows between 50 preceding and 1 preceding)),
bi as (select *, row_number() over ({BY}) i, coalesce(sum(case when abs(z) < 0.4 then 1 else 0 end) over ({BY} rows between unbounded preceding and 1 preceding), 0) isl from bz),
bt as (select symbol, isl, arg_min(seq, i) filter (abs(z) > 1.25) entry_seq, arg_max(seq, i) exit_seq, case when arg_min(z, i) filter (abs(z) > 1.25) > 0 then 1 else -1 end side, arg_min(price, i) filter (abs(z) > 1.25) entry_px, arg_max(price, i) exit_px, max(i) - min(i) filter (abs(z) > 1.25) holding from bi group by symbol, isl having count(*) filter (abs(z) > 1.25) > 0),
tr as (select symbol, entry_seq, exit_seq, side, entry_px, exit_px, cast(holding as bigint) holding, side * (exit_px - entry_px) * 1.0 - 0.0001 * entry_px - 0.0001 * exit_px pnl from bt)"""


def signal(s: SparkSession, d: str) -> DataFrame:
    return flow(s, d).withColumn("signal", F.col("ofi_86400s"))


def backtested(s: SparkSession, d: str) -> DataFrame:
    return bt.backtest(signal(s, d), STRATEGY, signal="signal")


query("w12_backtest_zscore", f"{BACK} select symbol, seq, {R('z')} z from bz")(lambda s, d: rounded(bt.signals(signal(s, d), STRATEGY, ["symbol"], signal="signal").select("symbol", "seq", "z")))
query("r1_backtest_trades", f"{BACK} select symbol, entry_seq, exit_seq, side, {R('entry_px')} entry_px, {R('exit_px')} exit_px, holding, {R('pnl')} pnl from tr")(lambda s, d: rounded(backtested(s, d)))
_ST = f"""{BACK}, ts0 as (select *, round(pnl, 4) p from tr), st as (select symbol, count(*) trades, count(*) filter (p > 0) wins, avg(p) avg_pnl, coalesce(sum(p) filter (p > 0), 0.0) gross_profit, -coalesce(sum(p) filter (p < 0), 0.0) gross_loss, sum(pnl) total_pnl, avg(cast(holding as double)) avg_holding, avg(p / round(entry_px, 4)) m, stddev_samp(p / round(entry_px, 4)) sd from ts0 group by symbol)"""
query("a19_trade_statistics", f"{_ST} select symbol, trades, wins, {R('wins / trades::double', 4)} win_rate, {R('avg_pnl', 4)} avg_pnl, {R('gross_profit', 3)} gross_profit, {R('gross_loss', 3)} gross_loss, {R('total_pnl', 4)} total_pnl, {R('avg_holding', 4)} avg_holding, {R('gross_profit / gross_loss', 3)} profit_factor, {R('m / sd', 4)} sharpe from st")(
    lambda s, d: bt.trade_statistics(backtested(s, d)).select("symbol", "trades", "wins", *(F.round(F.col(c) + TIE, k).alias(c) for c, k in (("win_rate", 4), ("avg_pnl", 4), ("gross_profit", 3), ("gross_loss", 3), ("total_pnl", 4), ("avg_holding", 4), ("profit_factor", 3), ("sharpe", 4))))
)
QUERIES["a20_trade_sharpe"] = lambda s, d: QUERIES["a19_trade_statistics"](s, d).select("symbol", "sharpe")
SQL["a20_trade_sharpe"] = f"select symbol, sharpe from ({SQL['a19_trade_statistics']})"
_EQ = f"""{BACK}, eq0 as (select b.symbol, b.seq, b.price, o.entry_seq oe, o.side oside, o.entry_px opx, c.pnl closed, c.entry_px back from bs b left join tr o on o.symbol = b.symbol and o.entry_seq = b.seq left join tr c on c.symbol = b.symbol and c.exit_seq = b.seq),
eq1 as (select *, 0.0001 * sum(coalesce(opx, 0.0) - coalesce(back, 0.0)) over ({BY}) paid, sum(coalesce(closed, 0.0)) over ({BY}) made, last_value(oe ignore nulls) over ({BY}) le, last_value(oside ignore nulls) over ({BY}) ls, last_value(opx ignore nulls) over ({BY}) lp, max(case when closed is not null then seq end) over ({BY}) lx from eq0),
eq as (select symbol, seq, 100000.0 + made - paid + case when le is not null and (lx is null or le > lx) then ls * (price - lp) else 0.0 end equity from eq1)"""


def curve(s: SparkSession, d: str) -> DataFrame:
    return bt.equity(signal(s, d), STRATEGY, signal="signal")


query("r1_equity_curve", f"{_EQ} select symbol, seq, {R('equity', 5)} equity from eq")(lambda s, d: rounded(curve(s, d), digits=5))
query("a21_max_drawdown", f"{_EQ}, pk as (select *, max(equity) over ({BY}) peak from eq) select symbol, {R('max(peak - equity)', 4)} max_drawdown, {R('arg_max(peak - equity, (peak - equity)) / arg_max(peak, peak - equity) * 100', 4)} max_drawdown_pct from pk group by symbol")(lambda s, d: rounded(bt.drawdown(curve(s, d)), digits=4))
query("a26_totals", f"{_ST} select cast(sum(trades) as bigint) trades, {R('sum(total_pnl)', 4)} total_pnl, {R('avg(wins / trades::double)', 4)} win_rate from st")(lambda s, d: rounded(bt.trade_statistics(backtested(s, d)).agg(F.sum("trades").alias("trades"), F.sum("total_pnl").alias("total_pnl"), F.avg("win_rate").alias("win_rate")), digits=4))

_P16 = {
    "total_pnl": "total_pnl", "win_rate": "wins / trades::double", "avg_pnl_per_trade": "avg_pnl", "sharpe_ratio": "case when trades > 1 and sd > 1e-12 then m / sd end", "max_drawdown": "dd", "max_drawdown_pct": "dd / peak * 100",
    "profit_factor": "case when gross_loss <= 1e-12 then 'inf'::double else gross_profit / gross_loss end",
}
query(
    "p16_backtest_summary",
    f"""{_EQ}, pk as (select *, max(equity) over ({BY}) peak from eq), mx as (select symbol, max(peak - equity) dd, arg_max(peak, peak - equity) peak from pk group by symbol),
ts0 as (select *, round(pnl, 4) p from tr), st as (select symbol, count(*) trades, count(*) filter (p > 0) wins, avg(p) avg_pnl, coalesce(sum(p) filter (p > 0), 0.0) gross_profit, -coalesce(sum(p) filter (p < 0), 0.0) gross_loss,
 sum(pnl) total_pnl, avg(p / round(entry_px, 4)) m, stddev_samp(p / round(entry_px, 4)) sd from ts0 group by symbol)
select symbol, coalesce(trades, 0) num_trades, {", ".join(f"{R(f'coalesce({x}, 0.0)', 3)} {c}" for c, x in _P16.items())} from mx left join st using (symbol)""",
)(lambda s, d: rounded(reports.backtest_summary(signal(s, d), STRATEGY, signal="signal"), digits=3))


FOLDS = bt.WalkForward(splits=3)


def walked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bt.walk_forward(signal(s, d), FOLDS, signal="signal")


_WALK = f"""{SPREADS}{OFI}, wb as (select symbol, seq, midprice price, ofi_86400s s, row_number() over ({BY}) - 1 i, count(*) over (partition by symbol) n from of2),
wf as (select wb.*, fold, n // 4 blk, n - 3 * (n // 4) + (fold - 1) * (n // 4) st from wb, (select unnest([1, 2, 3]) fold)),
ws as (select *, case when i < st then 'train' else 'test' end split from wf where i < st + blk),
wz as ({' union all '.join(f"select *, {k} lookback, {_Z(k)} z from ws window w as (partition by symbol, fold, split order by seq rows between {k} preceding and 1 preceding)" for k in (50, 100))}),
cd(cand, entry, out, lookback) as (values {', '.join(f"({i}, {e}::double, {x}::double, {k})" for i, (e, x, k) in enumerate(bt.GRID))}),
wc as (select symbol, fold, split, cand, seq, price, z, entry, out from wz join cd using (lookback)),
w1 as (select *, row_number() over k r, coalesce(sum(case when abs(z) < out then 1 else 0 end) over (partition by symbol, fold, split, cand order by seq rows between unbounded preceding and 1 preceding), 0) isl from wc window k as (partition by symbol, fold, split, cand order by seq)),
wt as (select symbol, fold, split, cand, isl, arg_min(seq, r) filter (abs(z) > entry) eseq, arg_max(seq, r) xseq, case when arg_min(z, r) filter (abs(z) > entry) > 0 then 1 else -1 end side, arg_min(price, r) filter (abs(z) > entry) epx, arg_max(price, r) xpx from w1 group by symbol, fold, split, cand, isl having count(*) filter (abs(z) > entry) > 0),
wp as (select *, side * (xpx - epx) - 0.001 * epx - 0.001 * xpx pnl, round(side * (xpx - epx) - 0.001 * epx - 0.001 * xpx, 4) p from wt),
wq as (select symbol, fold, split, cand, count(*) trades, count(*) filter (p > 0) wins, coalesce(sum(p) filter (p > 0), 0.0) gp, -coalesce(sum(p) filter (p < 0), 0.0) gl, sum(pnl) total, avg(p / round(epx, 4)) m, stddev_samp(p / round(epx, 4)) sd from wp group by all),
w2 as (select w1.symbol, w1.fold, w1.split, w1.cand, w1.seq, w1.price, o.eseq oe, o.side oside, o.epx opx, c.pnl closed, c.epx back from w1 left join wp o on o.symbol = w1.symbol and o.fold = w1.fold and o.split = w1.split and o.cand = w1.cand and o.eseq = w1.seq left join wp c on c.symbol = w1.symbol and c.fold = w1.fold and c.split = w1.split and c.cand = w1.cand and c.xseq = w1.seq),
w3 as (select *, 0.001 * sum(coalesce(opx, 0.0) - coalesce(back, 0.0)) over k paid, sum(coalesce(closed, 0.0)) over k made, last_value(oe ignore nulls) over k le, last_value(oside ignore nulls) over k ls, last_value(opx ignore nulls) over k lp, max(case when closed is not null then seq end) over k lx from w2 window k as (partition by symbol, fold, split, cand order by seq)),
w4 as (select symbol, fold, split, cand, seq, 100000.0 + made - paid + case when le is not null and (lx is null or le > lx) then ls * (price - lp) else 0.0 end equity from w3),
w5 as (select *, max(equity) over (partition by symbol, fold, split, cand order by seq) - equity dd from w4),
w6 as (select symbol, fold, split, cand, max(dd) dd from w5 group by all),
w7 as (select w6.*, entry, out, lookback, coalesce(trades, 0) trades, coalesce(total, 0.0) total, coalesce(wins / trades::double, 0.0) win_rate, case when trades is null then 0.0 when gl <= 1e-12 then 'inf'::double else gp / gl end profit_factor, case when trades > 1 and sd > 1e-12 then m / sd else 0.0 end sharpe from w6 join cd using (cand) left join wq using (symbol, fold, split, cand)),
best as (select * from w7 where split = 'train' qualify row_number() over (partition by symbol, fold order by round(total, 9) desc, round(sharpe, 9) desc, round(dd, 9), lookback, cand) = 1),
span as (select symbol, fold, min(st) train_end, min(st) test_start, min(st + blk) test_end from ws group by all),
wk as (select best.symbol, best.fold, best.cand, best.entry, best.out, best.lookback, best.total train_pnl, t.total test_pnl, t.trades test_trades, t.win_rate test_win_rate, t.profit_factor test_profit_factor, t.dd test_max_drawdown, train_end, test_start, test_end from best join w7 t on t.split = 'test' and t.symbol = best.symbol and t.fold = best.fold and t.cand = best.cand join span on span.symbol = best.symbol and span.fold = best.fold)"""
_WK = ("train_pnl", "test_pnl", "test_win_rate", "test_profit_factor", "test_max_drawdown")
query("r2_walk_forward", f'{_WALK} select symbol, fold, cand, entry, out as "exit", lookback, {", ".join(f"{R(c, 5)} {c}" for c in _WK)}, test_trades, train_end, test_start, test_end, 10.0::double cost_bps from wk')(
    lambda s, d: rounded(walked(s, d)[0], "entry", "exit", "cost_bps", digits=5)
)
_SUM = ("total_pnl", "mean_pnl", "median_pnl", "worst_pnl", "std_pnl", "profitable_ratio", "cv")
query(
    "a22_stability",
    f"""{_WALK}, st as (select symbol, sum(test_pnl) total_pnl, avg(test_pnl) mean_pnl, median(test_pnl) median_pnl, min(test_pnl) worst_pnl, stddev_samp(test_pnl) std_pnl, avg(case when test_pnl > 0 then 1.0 else 0.0 end) profitable_ratio, cast(sum(test_trades) as bigint) total_trades from wk group by symbol),
sv as (select *, std_pnl / abs(nullif(mean_pnl, 0)) cv from st), sg as (select *, total_pnl > 0 and median_pnl > 0 profitable, profitable_ratio >= 0.75 and coalesce(cv <= 1.5, false) stable from sv)
select symbol, {', '.join(f'{R(c, 5)} {c}' for c in _SUM)}, total_trades, profitable, stable, profitable and stable passed, concat_ws(',', case when not profitable then 'not_profitable_after_costs' end, case when profitable_ratio < 0.75 then 'inconsistent_fold_profitability' end, case when not coalesce(cv <= 1.5, false) then 'excessive_pnl_dispersion' end) reasons from sg""",
)(lambda s, d: rounded(walked(s, d)[1].withColumn("reasons", F.array_join("reasons", ",")), digits=5))
query("j4_folds", ", f as (select symbol, seq, row_number() over (" + BY + ") - 1 i, count(*) over (partition by symbol) n from ticks), g as (select f.*, fold, n // 4 blk, n - 3 * (n // 4) + (fold - 1) * (n // 4) st from f, (select unnest([1, 2, 3]) fold)) select symbol, fold, count(*) filter (i < st) n_train, count(*) filter (i >= st and i < st + blk) n_test from g group by all")(
    lambda s, d: bt.folds(ticks(s, d).select("symbol", "seq"), bt.WalkForward(splits=3), ["symbol"]).groupBy("symbol", "fold").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
)
query("l5_selection", f'{_WALK} select symbol, fold, entry, out as "exit", lookback from wk')(lambda s, d: walked(s, d)[0].select("symbol", "fold", "entry", "exit", "lookback"))

# execution
_IX = f", ix as (select *, cast(row_number() over ({BY}) - 1 as bigint) i, count(*) over (partition by symbol) n from ticks), nn as (select distinct symbol, n from ix)"
_SL = f"""{_IX}, sl as (select symbol, n, least(10, n) eff, j, cast(case when j = least(10, n) - 1 then n - 1 else floor(j * ((n - 1)::double / (least(10, n) - 1))) end as bigint) i from nn, (select unnest(range(10)) j) where j < least(10, n))"""
_TW = f"{_SL}, tw as (select symbol, cast(j as integer) j, i, cast(case when j = eff - 1 then 5000 - (5000 // eff) * (eff - 1) else 5000 // eff end as bigint) child from sl)"
query("r3_twap_schedule", f"{_TW} select symbol, j, i, child from tw where child > 0")(lambda s, d: execution.twap(execution.indexed(ticks(s, d)).select("symbol", "n").distinct(), F.lit(5000)))
_VW = f"""{_SL}, v0 as (select *, coalesce(cast(floor((i + lead(i) over (partition by symbol order by j)) / 2) as bigint), n) hi from sl), v1 as (select *, coalesce(lag(hi) over (partition by symbol order by j), 0) lo from v0),
dv as (select symbol, i, greatest(0, coalesce(volume - lag(volume) over ({BY}), 0)) d from ix), v2 as (select v1.symbol, v1.j, v1.i, eff, coalesce(sum(d), 0) v from v1 left join dv on dv.symbol = v1.symbol and dv.i >= lo and dv.i < hi group by all),
v3 as (select *, cast(floor(5000 * case when sum(v) over (partition by symbol) > 0 then v / (sum(v) over (partition by symbol))::double else 1.0 / eff end) as bigint) c from v2), v4 as (select *, cast(5000 - coalesce(sum(c) over (partition by symbol order by j rows between unbounded preceding and 1 preceding), 0) as bigint) rem from v3),
vw as (select symbol, cast(j as integer) j, i, case when j = eff - 1 then rem else least(c, rem) end child from v4)"""
query("r4_vwap_schedule", f"{_VW} select symbol, j, i, child from vw where child > 0")(lambda s, d: execution.vwap(execution.indexed(ticks(s, d)), F.lit(5000)))
_take = lambda k: f"greatest(0, least(ask_qty_{k}, 300 - ({' + '.join(['0', *(f'ask_qty_{i}' for i in range(1, k))])})))"
query("r5_walk_book", f" select seq, cast({' + '.join(_take(k) for k in range(1, 6))} as bigint) filled, {R(' + '.join(f'{_take(k)} * ask_px_{k}' for k in range(1, 6)))} cost from ticks")(lambda s, d: rounded(execution.walk_book(ticks(s, d), F.lit(300)).select("seq", "filled", "cost")))
_tk = lambda k: f"greatest(0, least(ask_qty_{k}, child - ({' + '.join(['0', *(f'ask_qty_{i}' for i in range(1, k))])})))"


def _fills(cte: str, name: str) -> str:
    return f"""{cte}, ar as (select symbol, (bid_px_1 + ask_px_1) / 2 arrival from ix where i = 0), fl as (select symbol, i, {' + '.join(_tk(k) for k in range(1, 6))} filled, {' + '.join(f'{_tk(k)} * ask_px_{k}' for k in range(1, 6))} cost from {name} join ix using (symbol, i) where child > 0),
fs as (select symbol, i, filled, cost, cost / filled px, (cost / filled - arrival) / arrival * 1e4 slip, arrival from fl join ar using (symbol) where filled > 0), vp as (select symbol, sum(ltp * ltq) / sum(ltq) vwap from ticks group by symbol)"""


def _summary(name: str) -> str:
    return f"select symbol, '{name}' strategy, 5000::bigint target_qty, cast(sum(filled) as bigint) filled_qty, {R('sum(cost) / sum(filled)')} avg_fill_price, {R('max(arrival)')} arrival_price, {R('max(vwap)')} session_vwap, {R('(sum(cost) / sum(filled) - max(arrival)) / max(arrival) * 1e4', 5)} implementation_shortfall_bps, {R('(sum(cost) / sum(filled) - max(vwap)) / max(vwap) * 1e4', 5)} vwap_slippage_bps, {R('arg_max(slip, i)', 5)} market_impact_bps from fs join vp using (symbol) group by symbol"


def simulated(s: SparkSession, d: str, kind: str) -> DataFrame:
    df = execution.simulate(ticks(s, d), kind, 5000)[1]
    return df.select(*(F.round(F.col(c) + TIE, 5 if c.endswith("bps") else 6).alias(c) if t == "double" else c for c, t in df.dtypes))


query("r6_simulate_twap", f"{_fills(_TW, 'tw')} {_summary('twap')}")(lambda s, d: simulated(s, d, "twap"))
query("r6_simulate_vwap", f"{_fills(_VW, 'vw')} {_summary('vwap')}")(lambda s, d: simulated(s, d, "vwap"))
query("j6_fills", f"{_fills(_TW, 'tw')} select symbol, i tick_idx, cast(filled as bigint) qty, {R('px')} price, {R('slip', 5)} slip_bps from fs")(lambda s, d: execution.simulate(ticks(s, d), "twap", 5000)[0].select("symbol", "tick_idx", "qty", F.round(F.col("price") + TIE, 6).alias("price"), F.round(F.col("slip_bps") + TIE, 5).alias("slip_bps")))
query("a23_session_vwap", f" select symbol, {R('sum(ltp * ltq) / sum(ltq)')} vwap from ticks group by symbol")(lambda s, d: rounded(execution.session_vwap(ticks(s, d))))
QUERIES["a24_execution_rollup"] = lambda s, d: QUERIES["r6_simulate_twap"](s, d).select("symbol", "filled_qty", "avg_fill_price", "market_impact_bps")
SQL["a24_execution_rollup"] = f"select symbol, filled_qty, avg_fill_price, market_impact_bps from ({SQL['r6_simulate_twap']})"
QUANTITIES = (100, 500, 1000, 2000)


def compared(s: SparkSession, d: str) -> DataFrame:
    df = execution.compare(ticks(s, d), list(QUANTITIES))
    return df.select(*(F.round(F.col(c) + TIE, 5 if c.endswith("bps") else 6).alias(c) if t == "double" else c for c, t in df.dtypes))


QUERIES["j5_quantity_strategy"] = compared
SQL["j5_quantity_strategy"] = " union all ".join(f"select * from ({SQL[f'r6_simulate_{k}'].replace('5000', str(q))})" for q in QUANTITIES for k in ("twap", "vwap"))

# histories, topics, limits
query("l1_last_alerts", f"{ALERTS} select symbol, seq, place, kind from al order by seq desc, place desc limit 10")(lambda s, d: al.last_alerts(alerts(s, d), 10).select("symbol", "seq", "place", "kind"))
query("l2_last_by_symbol", " select symbol, seq, ltp from ticks qualify row_number() over (partition by symbol order by seq desc) <= 300")(lambda s, d: al.last_by_key(ticks(s, d).select("symbol", "seq", "ltp"), 300))
query("l3_newest_first", f"{ALERTS} select kind, seq, place from al")(lambda s, d: alerts(s, d).select("kind", "seq", "place").orderBy(F.desc("seq"), F.desc("place")))
query("p4_anomaly_record", f"{ALERTS} select seq, symbol, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '+00:00' ts, kind, severity, zscore from al join ticks using (symbol, seq)")(
    lambda s, d: reports.anomaly_records(alerts(s, d)).select("seq", "symbol", "ts", "kind", "severity", F.col("detail")["zscore"].alias("zscore"))
)
query("l8_head", " select seq, symbol, ltp from ticks order by seq limit 5")(lambda s, d: ticks(s, d).select("seq", "symbol", "ltp").orderBy("seq").limit(5))
query("p11_symbol_and_kind", f"{ALERTS} select seq, zscore from al where symbol = 'VIEW' and kind = 'spread_blowup'")(lambda s, d: alerts(s, d).where((F.col("symbol") == "VIEW") & (F.col("kind") == "spread_blowup")).select("seq", "zscore"))
query("p12_non_null", f"{RET} select seq, symbol from rt where ret is not null and ret <> 0 and isfinite(ret)")(lambda s, d: returns(s, d).dropna(subset=["ret"]).where((F.col("ret") != 0) & ~F.isnan("ret") & (F.abs("ret") != float("inf"))).select("seq", "symbol"))
query("src10_latest", " select symbol, max(seq) seq, arg_max(ltp, seq) ltp from ticks group by symbol")(lambda s, d: al.latest(ticks(s, d).select("symbol", "seq", "ltp")))
query("src6_read_day", " select seq, ltp from ticks where symbol = 'VIEW' and cast(ts as date) = date '2024-01-05'")(lambda s, d: store.read_day_of(ticks(s, d), "VIEW", "2024-01-05").select("seq", "ltp"))
query("snk1_buckets", " select symbol, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H') || lpad(cast((minute(ts) // 15) * 15 as varchar), 2, '0') bucket, count(*) n from ticks group by all")(lambda s, d: store.placed(ticks(s, d)).groupBy("symbol", "day", "bucket").agg(F.count("*").alias("n")))
query("snk10_topic_queues", " , m as (select 'book:' || symbol topic, seq from ticks) select topic, seq from m qualify row_number() over (partition by topic order by seq desc) <= 200")(
    lambda s, d: al.drop_oldest(ticks(s, d).select(F.concat(F.lit("book:"), "symbol").alias("topic"), "seq"))[0]
)
query("snk10_drops", " select 'book:' || symbol topic, greatest(0, count(*) - 200) dropped from ticks group by symbol")(lambda s, d: al.drop_oldest(ticks(s, d).select(F.concat(F.lit("book:"), "symbol").alias("topic"), "seq"))[1])
query("snk13_exposition", f"""{_CODES}, c as (select count(*) received, count(*) filter (codes = '') accepted, count(*) filter (codes <> '') rejected, count(*) filter (codes = '' and dirty) repaired from codes),
v as (select unnest([('received', received), ('accepted', accepted), ('rejected', rejected), ('repaired', repaired)]) v from c) select unnest(['# HELP ticks_' || v[1] || '_total Ticks ' || v[1], '# TYPE ticks_' || v[1] || '_total counter', 'ticks_' || v[1] || '_total ' || v[2]]) line from v""")(lambda s, d: al.exposition(quality.counters(quality.gate(spoilt(s, d))).select(F.inline(F.array(*(F.struct(F.lit(f"ticks_{c}_total").alias("name"), F.lit("counter").alias("kind"), F.lit(f"Ticks {c}").alias("help"), F.col(c).alias("value")) for c in ("received", "accepted", "rejected", "repaired")))))))
query("st11_rate_limit", " select seq, count(*) over (partition by user_id, us // 3600000000 order by seq rows between unbounded preceding and current row) <= 2 allowed from (select event_id seq, user_id % 5 user_id, epoch_us(ts) us from events)".replace("3600000000", "60000000"))(
    lambda s, d: al.rate_limit(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "user_id", "us", 2).select("seq", "allowed")
)
def like_the_ticks(s: SparkSession, d: str, seed: int) -> DataFrame:
    """Generated snapshots of the table's symbols (a short list of names), for each as many as the busiest one has ticks."""
    n = ticks(s, d).groupBy("symbol").agg(F.count("*").alias("n")).orderBy("symbol").collect()
    return synthetic.make_source(s, ticks=max(r["n"] for r in n), seed=seed, symbols=",".join(r["symbol"] for r in n))


query("src2_synthetic")(lambda s, d: like_the_ticks(s, d, 42))
query("src4_vendor_messages", " select seq, ltp, round(bid_px_1 * 100) / 100 bid_px_1, ltq from ticks")(
    lambda s, d: books.flatten(
        store.normalise(
            ticks(s, d).select("seq", F.to_json(F.struct(F.round(F.col("ltp") * 100).cast("long").alias("last_traded_price"), F.col("ltq").alias("last_traded_quantity"), F.array(F.struct(F.round(F.col("bid_px_1") * 100).cast("long").alias("price"), F.col("bid_qty_1").alias("quantity"))).alias("best_5_buy_data"))).alias("raw")), "X"
        )
    ).select("seq", "ltp", "bid_px_1", "ltq")
)
def vendor_books(s: SparkSession, d: str) -> DataFrame:
    """Messages of seven levels a side; one in 11 without asks, one in 13 without a last price, orders in every second."""
    t = ticks(s, d)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    level = lambda side, i: F.struct(cents(f"{side}_px_{i}").alias("price"), F.col(f"{side}_qty_{i}").alias("quantity"), F.when(F.col("seq") % 2 == 0, F.lit(i)).alias("no_of_orders"))
    beyond = F.struct(F.lit(1).cast("long").alias("price"), F.lit(1).cast("long").alias("quantity"), F.lit(9).alias("no_of_orders"))
    book = lambda side: F.array(*(level(side, i) for i in range(1, 6)), beyond, beyond)
    raw = F.struct(
        F.floor(F.col("us") / 1000).alias("exchange_timestamp"), F.when(F.col("seq") % 13 == 0, 0).otherwise(cents("ltp")).alias("last_traded_price"), F.col("ltq").alias("last_traded_quantity"),
        F.col("volume").alias("volume_trade_for_the_day"), book("bid").alias("best_5_buy_data"), F.when(F.col("seq") % 11 > 0, book("ask")).alias("best_5_sell_data"),
    )
    got = store.normalise(t.select("seq", F.to_json(raw).alias("raw")), "X")
    orders = F.aggregate(F.concat("bids", "asks"), F.lit(0), lambda a, x: a + x["orders"])
    return got.select("seq", F.unix_micros("ts").alias("us"), F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.get("bids", F.lit(4))["price"].alias("last_bid"), orders.alias("orders"), F.coalesce("ltp", F.lit(-1.0)).alias("ltp"), "volume")


query("src4_vendor_books", """ select seq, us // 1000 * 1000 us, 5 n_bids, case when seq % 11 = 0 then 0 else 5 end n_asks, round(bid_px_5 * 100) / 100 last_bid,
 case when seq % 2 = 0 then 15 + case when seq % 11 = 0 then 0 else 15 end else 0 end orders, case when seq % 13 = 0 then -1.0 else round(ltp * 100) / 100 end ltp, volume from ticks""")(vendor_books)
query("u1_union_all", " select seq, symbol from ticks where symbol = 'VIEW' union all select seq, symbol from ticks where symbol = 'CLICK'")(lambda s, d: ticks(s, d).where("symbol = 'VIEW'").select("seq", "symbol").unionAll(ticks(s, d).where("symbol = 'CLICK'").select("seq", "symbol")))
#: The scan reads its rows several times: snapshots are generated once and kept on the executors' disks until the session ends.
query("r8_generate")(lambda s, d: est.metrics(books.flatten(like_the_ticks(s, d, 7).persist(StorageLevel.DISK_ONLY))))
