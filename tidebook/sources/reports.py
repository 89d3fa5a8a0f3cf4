"""Files and views that a run leaves: trade logs, equity tables, fold results, comparisons, sample data, service views.

Everything is written by Spark: CSV with a header or JSON lines, a folder each. JSON is strict: NaN and infinity are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators import alerts as al
from tidebook.operators import backtest, books, execution, quality
from tidebook.operators import estimators as est
from tidebook.sources.store import write_csv, write_json


def iso(ts: Column) -> Column:
    """ISO-8601 with the offset; microseconds only where there are any."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def anomaly_records(alerts: DataFrame) -> DataFrame:
    """Alerts (symbol, seq, ts, kind, severity, detail) as records with their time in ISO-8601, in their order."""
    return alerts.select("seq", iso(F.col("ts")).alias("ts"), "symbol", "kind", "severity", "detail")


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinity become null in columns of doubles."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    return df.select(*(fine(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns))


def ticked(df: DataFrame, *names: str, ticks: DataFrame) -> DataFrame:
    """Adds for each of the columns (a seq) `<name>_tick`, the row's place among its symbol's ticks from 0."""
    place = ticks.select("symbol", "seq", (F.row_number().over(Window.partitionBy("symbol").orderBy("seq")) - 1).alias("_tick"))
    for n in names:
        df = df.join(place.select("symbol", F.col("seq").alias(f"{n}_seq"), F.col("_tick").alias(f"{n}_tick")), ["symbol", f"{n}_seq"], "left")
    return df


def trade_log(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """A row for each trade, with places instead of sequence numbers."""
    got = ticked(trades, "entry", "exit", ticks=ticks)
    return got.select("symbol", "entry_tick", "exit_tick", F.when(F.col("side") > 0, "long").otherwise("short").alias("side"), "entry_px", "exit_px", "pnl", F.col("holding").alias("holding_ticks"))


def equity_table(curves: DataFrame, symbols: list[str]) -> DataFrame:
    """(tick, a column for each symbol) from (symbol, seq, equity); the symbols are a short list of names."""
    placed = curves.withColumn("tick", F.row_number().over(Window.partitionBy("symbol").orderBy("seq")) - 1)
    return placed.groupBy("tick").pivot("symbol", symbols).agg(F.first("equity"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, other columns as they are."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def backtest_summary(ticks: DataFrame, strategy: backtest.Strategy = backtest.Strategy(), **columns: str) -> DataFrame:
    """A row for each symbol: profit, trades, win rate, Sharpe ratio, drawdown and profit factor; zeros where nothing was traded."""
    held = backtest.run(ticks, strategy, ["symbol"], **columns)
    stats = backtest.trade_statistics(backtest.trades(held, ["symbol"]))
    falls = backtest.drawdown(backtest.capital(held, ["symbol"], strategy.capital))
    got = falls.join(stats, "symbol", "left")
    names = {"total_pnl": "total_pnl", "trades": "num_trades", "win_rate": "win_rate", "avg_pnl": "avg_pnl_per_trade", "sharpe": "sharpe_ratio", "profit_factor": "profit_factor"}
    filled = {new: F.coalesce(F.col(old), F.lit(0)).alias(new) for old, new in names.items()}
    return got.select("symbol", *(filled[c] for c in ("total_pnl", "num_trades", "win_rate", "avg_pnl_per_trade", "sharpe_ratio")), "max_drawdown", "max_drawdown_pct", filled["profit_factor"])


def execution_summary(fills: DataFrame, summary: DataFrame) -> DataFrame:
    """Both results of execution.simulations() as a comparison table: with the number of fills, rounded to 4 digits."""
    own = ["symbol", "target_qty", "strategy"]
    got = summary.join(fills.groupBy(*own).agg(F.count("*").alias("num_fills")), own, "left")
    names = {"filled_qty": "total_filled", "avg_fill_price": "avg_fill_price", "arrival_price": "arrival_price", "session_vwap": "vwap_price", "implementation_shortfall_bps": "impl_shortfall_bps", "vwap_slippage_bps": "vwap_slippage_bps", "market_impact_bps": "last_fill_slippage_bps"}
    return rounded(got.select("symbol", "strategy", "target_qty", F.coalesce("num_fills", F.lit(0)).alias("num_fills"), *(F.col(a).alias(b) for a, b in names.items())))


def write_backtest(ticks: DataFrame, root: str, symbols: list[str], strategy: backtest.Strategy = backtest.Strategy(), **columns: str) -> None:
    """trades.csv, equity.csv and summary.json of a backtest, a strict record for each symbol in the latter."""
    write_csv(trade_log(backtest.backtest(ticks, strategy, **columns), ticks), f"{root}/trades.csv")
    write_csv(equity_table(backtest.equity(ticks, strategy, **columns), symbols), f"{root}/equity.csv")
    write_json(strict(rounded(backtest_summary(ticks, strategy, **columns))), f"{root}/summary.json", "overwrite")


def write_walk_forward(folds: DataFrame, summary: DataFrame, root: str) -> None:
    """folds.csv, a row for each symbol and fold, and summary.json, a strict record for each symbol."""
    write_csv(folds, f"{root}/folds.csv")
    write_json(strict(summary), f"{root}/summary.json", "overwrite")


def write_execution(ticks: DataFrame, root: str, targets: list[int]) -> None:
    """comparison.csv of both schedules for each quantity."""
    write_csv(execution_summary(*execution.simulations(ticks, ["twap", "vwap"], targets)), f"{root}/comparison.csv")


def write_sample(snapshots: DataFrame, root: str, seed: int, purpose: str = "software validation only") -> None:
    """ticks.csv, metrics.csv, anomalies.csv and manifest.json of a (synthetic) run."""
    ticks = books.flatten(snapshots)
    found = anomaly_records(est.anomalies(est.order_flow(est.metrics_input(ticks), ())))
    write_csv(ticks.withColumn("timestamp", iso(F.col("ts"))).drop("ts"), f"{root}/ticks.csv")
    write_csv(est.metrics(ticks).drop("us"), f"{root}/metrics.csv")
    write_csv(found.withColumn("detail", F.to_json("detail")), f"{root}/anomalies.csv")
    counts = ticks.agg(F.count("*").alias("total_ticks"), F.sort_array(F.collect_set("symbol")).alias("symbols")).crossJoin(found.agg(F.count("*").alias("total_anomalies")))  # one row each
    write_json(counts.select(F.lit(seed).alias("seed"), "symbols", "total_ticks", "total_anomalies", F.lit(purpose).alias("purpose")), f"{root}/manifest.json", "overwrite")


def write_timings(long: DataFrame, root: str, **names: str) -> None:
    """timings.csv: statistics of each module's latencies; summary.json: the same as strict records of 2 digits."""
    from tidebook.operators.research import timing_block

    block = timing_block(long, **names)
    write_csv(block, f"{root}/timings.csv")
    write_json(strict(rounded(block, 2)), f"{root}/summary.json", "overwrite")


def symbols_view(ticks: DataFrame) -> DataFrame:
    return ticks.select("symbol").distinct().orderBy("symbol")


def health_view(state: dict, source: str, symbols: list[str]) -> dict:
    """What a health endpoint returns from streaming.live.health()."""
    return {"status": "ok" if state["healthy"] else "degraded", "source": source, "symbols": symbols, **state}


def data_quality_view(gated: DataFrame) -> DataFrame:
    """One row: the gate's counters, the share accepted and a map of rejections by reason."""
    reasons = quality.reason_counts(gated).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejected_by_reason"))  # fourteen reasons at most
    rate = F.coalesce(F.try_divide("accepted", "received"), F.lit(1.0))
    return quality.counters(gated).withColumn("acceptance_rate", rate).crossJoin(reasons)


def volume_profile_view(ticks: DataFrame) -> DataFrame:
    """(symbol, profile): each symbol's profile as a map in order of the price."""
    return est.profile_map(est.volume_profile(ticks))


def recent_alerts_view(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return anomaly_records(al.last_alerts(alerts, limit))
