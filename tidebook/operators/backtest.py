"""Flow z-score backtest and walk-forward evaluation as windows and aggregates, without a sequential loop.

Between two exit signals (|z| < exit) there is at most one trade: it opens at the first entry signal (|z| > entry) of
that island and closes at the exit signal that ends it, or at the last row. This needs entry >= exit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import rolling
from tidebook.operators import estimators
from tidebook.schema import require


@dataclass(frozen=True)
class Strategy:
    lookback: int = 100
    entry: float = 1.5
    exit: float = 0.3
    cost_bps: float = 1.0
    size: float = 1.0
    capital: float = 100_000.0

    def __post_init__(self):
        if self.entry < self.exit:
            raise ValueError("entry must not be below exit")


@dataclass(frozen=True)
class WalkForward:
    splits: int = 4
    cost_bps: float = 10.0
    least_ratio: float = 0.75
    most_cv: float = 1.5

    def __post_init__(self):
        if self.splits < 2 or self.cost_bps < 0 or not 0 <= self.least_ratio <= 1 or self.most_cv < 0:
            raise ValueError("splits >= 2, costs and variation >= 0 and a ratio from 0 to 1 are needed")


#: Entry, exit and lookback of the twelve candidates.
GRID = [(e, x, n) for e in (1.25, 1.5, 2.0) for x in (0.2, 0.4) for n in (50, 100)]


def _by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("seq")


def rolling_zscore(df: DataFrame, signal: str, lookbacks: dict[str, int], keys: list[str]) -> DataFrame:
    """Adds a z-score by name against the so many rows before (sample deviation of those with a finite value, two at least); 0 where undefined.

    A scan over chunks of each key's rows: one pass for all lookbacks, and no frame is summed up anew for each row.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    one = df.withColumnsRenamed(names).withColumn("symbol", F.to_json(F.struct(*names.values())))
    got = estimators.scan(one, {name: rolling.Lagged(signal, name, n) for name, n in lookbacks.items()})
    return got.drop("symbol").withColumnsRenamed({v: k for k, v in names.items()})


def positions(df: DataFrame, keys: list[str], entry: Column, exit: Column, cost_bps: Column, size: float = 1.0) -> DataFrame:
    """Rows (keys, seq, price, z, cut and others) with what is held, without a loop and without a join.

    `held`: the position's entry (seq, price, z, i), if there is one on this row, its exit row included; `out`: it ends here by its signal.
    `mark`: profit of closed trades and of the open position on this row; `closed`: the same if it were closed here;
    `pnl`: the position's profit if it were closed here. A row is `cut` where a position is closed whatever the signal says.
    """
    by, c = _by(keys), cost_bps / 1e4 * size
    df = df.withColumns({"i": F.row_number().over(by), "out": F.abs("z") < exit})
    df = df.withColumn("_isl", F.coalesce(F.sum(F.col("out").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    island = _by([*keys, "_isl"]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("held", F.first(F.when(F.abs("z") > entry, F.struct("seq", "price", "z", "i")), True).over(island))
    df = df.withColumn("side", F.when(F.col("held.z") > 0, 1).when(F.col("held").isNotNull(), -1))
    opened = F.col("side") * (F.col("price") - F.col("held.price")) * size - c * F.col("held.price")
    df = df.withColumns({"_open": opened, "pnl": opened - c * F.col("price")})
    made = F.coalesce(F.sum(F.when(F.col("out"), F.col("pnl"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    now = F.when(F.col("held").isNull(), 0.0)
    return df.withColumn("_made", made).withColumns(
        {"mark": F.col("_made") + now.when(F.col("out"), F.col("pnl")).otherwise(F.col("_open")), "closed": F.col("_made") + now.otherwise(F.col("pnl"))}
    ).drop("_isl", "_open", "_made")


def trades(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entry_seq, exit_seq, side, entry_px, exit_px, holding, pnl) of positions()."""
    got = held.where((F.col("out") | F.col("cut")) & F.col("held").isNotNull())
    return got.select(*keys, F.col("held.seq").alias("entry_seq"), F.col("seq").alias("exit_seq"), "side", F.col("held.price").alias("entry_px"), F.col("price").alias("exit_px"), (F.col("i") - F.col("held.i")).cast("long").alias("holding"), "pnl")


def signals(df: DataFrame, strategy: Strategy, keys: list[str], price: str = "midprice", signal: str = "ofi_300s") -> DataFrame:
    require(df, price, signal, "seq", *keys)
    rows = df.select(*keys, "seq", F.col(price).alias("price"), F.col(signal).cast("double").alias("_value"))
    return rolling_zscore(rows, "_value", {"z": strategy.lookback}, keys).drop("_value")


def run(df: DataFrame, strategy: Strategy, keys: list[str], **columns: str) -> DataFrame:
    """positions() of a strategy on each key's series; the last row closes what is open."""
    z = signals(df, strategy, keys, **columns).withColumn("cut", F.lead(F.lit(1)).over(_by(keys)).isNull())
    return positions(z, keys, F.lit(strategy.entry), F.lit(strategy.exit), F.lit(strategy.cost_bps), strategy.size)


def backtest(df: DataFrame, strategy: Strategy = Strategy(), keys: tuple[str, ...] = ("symbol",), **columns: str) -> DataFrame:
    """The trades of a strategy on each key's series."""
    return trades(run(df, strategy, list(keys), **columns), list(keys))


def capital(held: DataFrame, keys: list[str], start: float) -> DataFrame:
    """(keys, seq, equity) of positions()."""
    return held.select(*keys, "seq", (start + F.when(F.col("cut"), F.col("closed")).otherwise(F.col("mark"))).alias("equity"))


def equity(df: DataFrame, strategy: Strategy = Strategy(), keys: tuple[str, ...] = ("symbol",), **columns: str) -> DataFrame:
    """(keys, seq, equity) of a strategy on each key's series: capital, realised profit and costs, the open position's profit."""
    return capital(run(df, strategy, list(keys), **columns), list(keys), strategy.capital)


def trade_statistics(t: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, win rate, means, profit factor (infinite without losses) and Sharpe ratio of trades; per-trade values have 4 digits."""
    p = F.round("pnl", 4)
    got = t.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(p > 0).alias("wins"),
        F.avg(p).alias("avg_pnl"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("gross_profit"),
        (-F.coalesce(F.sum(F.when(p < 0, p)), F.lit(0.0))).alias("gross_loss"),
        F.sum("pnl").alias("total_pnl"),
        F.avg(p / F.round("entry_px", 4)).alias("_m"),
        F.stddev_samp(p / F.round("entry_px", 4)).alias("_value"),
        F.avg("holding").alias("avg_holding"),
    )
    got = got.withColumns({"win_rate": F.col("wins") / F.col("trades"), "profit_factor": F.when(F.col("gross_loss") <= 1e-12, F.lit(float("inf"))).otherwise(F.col("gross_profit") / F.nullif("gross_loss", F.lit(0.0)))})
    return got.withColumn("sharpe", F.when((F.col("trades") > 1) & (F.col("_value") > 1e-12), F.col("_m") / F.nullif("_value", F.lit(0.0))).otherwise(0.0)).drop("_m", "_value")


def drawdown(lines: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, max_drawdown, max_drawdown_pct): the deepest fall from a peak, the first one of equals, and its share of that peak."""
    sofar = _by(list(keys)).rowsBetween(Window.unboundedPreceding, 0)
    peak = lines.withColumn("peak", F.max("equity").over(sofar)).withColumn("dd", F.col("peak") - F.col("equity"))
    top = peak.groupBy(*keys).agg(F.max_by(F.struct("dd", "peak"), F.struct("dd", -F.col("seq"))).alias("m"))
    return top.select(*keys, F.col("m.dd").alias("max_drawdown"), F.coalesce(F.try_divide(F.col("m.dd"), F.col("m.peak")) * 100, F.lit(0.0)).alias("max_drawdown_pct"))


def candidates(spark, grid=GRID) -> DataFrame:
    """The parameter grid (cand, entry, exit, lookback); as large as its list."""
    return spark.createDataFrame([(i, float(e), float(x), int(n)) for i, (e, x, n) in enumerate(grid)], "cand int, entry double, exit double, lookback int")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `i`, a row's place in its key's series from 0, and `n`, the series' length: counts of buckets of `seq` first, places in a bucket after."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    bucket = F.floor(F.col("seq") / estimators.BUCKET)
    n = df.select(*(F.col(k).alias(v) for k, v in names.items()), bucket.alias("_b")).groupBy(*names.values(), "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*names.values())
    n = n.withColumns({"_before": F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(whole)}).drop("_n")
    same = bucket == F.col("_b")
    for k, v in names.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    place = F.row_number().over(Window.partitionBy(*names.values(), "_b").orderBy("seq"))
    return df.join(n, same).withColumn("i", F.col("_before") + place - 1).drop("_b", "_before", *names.values())


def blocks(df: DataFrame, config: WalkForward, keys: list[str]) -> DataFrame:
    """Rows with `i`, `n`, `size` and `block`: 0 trains only, f is tested in fold f and trains later folds."""
    df = numbered(df, keys).withColumn("size", F.floor(F.col("n") / (config.splits + 1)).cast("long"))
    first = F.col("n") - config.splits * F.col("size")
    return df.withColumn("block", F.when(F.col("i") < first, 0).otherwise(1 + F.floor((F.col("i") - first) / F.col("size"))).cast("int"))


def folds(df: DataFrame, config: WalkForward, keys: list[str]) -> DataFrame:
    """(keys, seq, i, n, size, block, fold, split): each row once in the test block of its fold and in the training of later folds."""
    each = blocks(df, config, keys).withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(config.splits))))
    return each.withColumn("split", F.when(F.col("fold") == F.col("block"), "test").otherwise("train"))


def check_sizes(df: DataFrame, config: WalkForward, lookback: int, keys: list[str]) -> None:
    least = df.groupBy(*keys).count().agg(F.min("count")).first()[0] or 0
    if least // (config.splits + 1) <= lookback:
        raise ValueError(f"{least} rows are too few for {config.splits} splits with a lookback of {lookback}")


def islands(z: np.ndarray, price: np.ndarray, entry: float, exit: float, state=(np.nan, np.nan)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(out, side, price of entry) of what is held on each row, nan where nothing is; state: side and price that are held before."""
    n = len(z)
    out = np.abs(z) < exit
    number = np.cumsum(out) - out
    start = np.r_[0, np.flatnonzero(out) + 1]
    first = np.minimum.reduceat(np.where(np.abs(z) > entry, np.arange(n), n), start[start < n])[number]
    there = first <= np.arange(n)
    at = np.where(there, first, 0)
    side, held = np.where(there, np.where(z[at] > 0, 1.0, -1.0), np.nan), np.where(there, price[at], np.nan)
    if state[0] == state[0]:
        side[number == 0], held[number == 0] = state
    return out, side, held


def _round(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 1e4 + 0.5) / 1e4, x)


def stretches(z: np.ndarray, price: np.ndarray, block: np.ndarray, entry: float, exit: float, state, cost: float) -> list[tuple]:
    """For each block in a chunk of a run what a candidate does there, profits from 0: see block_summaries(). The last row stands by itself."""
    out, side, held = islands(z, price, entry, exit, state)
    there = side == side
    opened = side * (price - held) - cost * held
    pnl = opened - cost * price
    own = out & there
    gains = np.where(own & (pnl == pnl), pnl, 0.0)
    made = np.cumsum(gains) - gains
    mark = made + np.where(~there, 0.0, np.where(out, pnl, opened))
    closed = made + np.where(~there, 0.0, pnl)
    p = _round(pnl)
    part = np.divide(p, _round(held), out=np.full(len(p), np.nan), where=held != 0)
    got = []
    begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for a, e in zip(begin.tolist(), np.r_[begin[1:], len(block)].tolist()):
        mine = np.flatnonzero(own[a:e]) + a
        q, share = p[mine][~np.isnan(p[mine])], part[mine][~np.isnan(part[mine])]
        body = mark[a : e - 1][~np.isnan(mark[a : e - 1])] - made[a]
        last = e - 1
        forced = (pnl[last], p[last], part[last]) if there[last] and not out[last] else (None,) * 3
        got.append((
            int(block[a]), len(mine), int((q > 0).sum()), float(q[q > 0].sum()), float(-q[q < 0].sum()), float(gains[a:e].sum()), float(share.mean()) if len(share) else 0.0, float(share.var()) if len(share) else 0.0, *forced,
            *((body.max(), body.min(), (np.maximum.accumulate(body) - body).max()) if len(body) else (None,) * 3), mark[last] - made[a], closed[last] - made[a],
        ))
    return got


def block_summaries(rows: DataFrame, grid, cost_bps: float, keys: list[str]) -> DataFrame:
    """(keys, run, cand, block, chunk, ...) of rows (keys, seq, price, _value, block): what each candidate does in a block, in parts that can be merged.

    Run 0 is the series up to the last test block, run f the test block of fold f by itself, with no past. The parts: trades that end in the
    block by their signal (`own`), the one that a cut at its last row would close (`forced`), and the block's peak, low and
    deepest fall without its last row, whose capital is `at_cut`, or `closed` after a cut. Each row is in two runs, however many folds there are.
    A block has one part for each chunk of its rows; a chunk leaves the next one what each candidate holds, so no task has a whole series.
    """
    runs = F.when(F.col("block") == 0, F.array(F.lit(0))).when(F.col("_last"), F.array("block")).otherwise(F.array(F.lit(0), F.col("block")))
    rows = rows.withColumn("run", F.explode(runs)).drop("_last")
    z = rolling_zscore(rows, "_value", {f"_z{n}": n for n in sorted({n for _, _, n in grid})}, [*keys, "run"])
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "run"])}
    one = z.select(*(F.col(k).alias(v) for k, v in names.items()), "block", "seq", "price", *(f"_z{n}" for n in sorted({n for _, _, n in grid})))
    one = estimators.chunked(one.withColumn("symbol", F.to_json(F.struct(*names.values()))))
    groups, cost = one.groupBy("symbol", "_chunk"), cost_bps / 1e4

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        return estimators.arrays(t.drop_columns(["symbol", *names.values()]), np.argsort(t.column("seq").to_numpy(), kind="stable"))

    def left(key: tuple, t: pa.Table) -> pa.Table:
        """Of each candidate whether it goes out in the chunk, and what it holds after it."""
        r, got = columns(t), []
        for e, x, n in grid:
            out, side, held = islands(r[f"_z{n}"], r["price"], e, x)
            got += [float(out.any()), *((np.nan, np.nan) if out[-1] else (side[-1], held[-1]))]
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "_chunk": pa.array([key[1].as_py()], pa.int64()), "_held": pa.array([got], pa.list_(pa.float64()))})

    def joined(batches):
        """What is held before chunks, from what they leave in order."""
        symbol, state = object(), None
        for b in batches:
            before = []
            for s, own in zip(b.column("symbol").to_pylist(), b.column("_held").to_pylist()):
                if s != symbol:
                    symbol, state = s, np.full((len(grid), 2), np.nan)
                before.append(state.ravel())
                own = np.array(own).reshape(-1, 3)
                state = np.where((own[:, :1] > 0) | np.isnan(state[:, :1]), own[:, 1:], state)
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("_chunk"), pa.array(before, pa.list_(pa.float64()))], names=["symbol", "_chunk", "_held"])

    def run(key: tuple, t: pa.Table, state: pa.Table) -> pa.Table:
        r, old = columns(t), np.array(state.column("_held")[0].as_py()).reshape(-1, 2)
        got = [(c, *x) for c, (e, out, n) in enumerate(grid) for x in stretches(r[f"_z{n}"], r["price"], r["block"], e, out, tuple(old[c]), cost)]
        head = [pa.array([t.column(v)[0].as_py()] * len(got), t.schema.field(v).type) for v in names.values()]
        cols = [pa.array(x, kind, from_pandas=True) for x, kind in zip(zip(*got), [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 13])]
        return pa.table([*head, pa.array([key[1].as_py()] * len(got), pa.int64()), *cols], names=[*names.values(), "chunk", *fields])

    fields = ["cand", "block", "_n", "_wins", "_gain", "_loss", "_total", "_mean", "_var", "_pnl", "_p", "_part", "_peak", "_low", "_fall", "_at", "_closed"]
    kind = "symbol string, _chunk long, _held array<double>"
    states = groups.applyInArrow(left, kind).repartition("symbol").sortWithinPartitions("symbol", "_chunk").mapInArrow(joined, kind)
    heads = ", ".join(f"{v} {one.schema[v].dataType.simpleString()}" for v in names.values())
    parts = groups.cogroup(states.groupBy("symbol", "_chunk")).applyInArrow(run, f"{heads}, chunk long, cand int, block int, _n long, _wins long, " + ", ".join(f"{c} double" for c in fields[4:]))
    parts = parts.withColumnsRenamed({v: k for k, v in names.items()})
    by = Window.partitionBy(*keys, "run", "cand").orderBy("chunk", "block")  # a chunk's parts, few
    nxt = F.lead("block").over(by)
    parts = parts.withColumns({"cut": nxt.isNull() | (nxt != F.col("block")), "_made": F.coalesce(F.sum("_total").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    cut, p, on = F.col("cut"), F.col("_p"), lambda c: F.col("_made") + F.col(c)
    forced = F.when(cut & F.col("_pnl").isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), (p > 0).cast("long").alias("wins"), F.when(p > 0, p).otherwise(0.0).alias("gain"), F.when(p < 0, -p).otherwise(0.0).alias("loss"), F.col("_pnl").alias("total"), F.col("_part").alias("mean"), F.lit(0.0).alias("var")))
    last = F.when(~cut, F.col("_at"))  # a last row that is none of the block's is one like the others
    return parts.select(
        *keys, "run", "cand", "block", "chunk",
        F.struct(*(F.col(f"_{c}").alias(c) for c in ("n", "wins", "gain", "loss", "total", "mean", "var"))).alias("own"), forced.alias("forced"),
        (F.col("_made") + F.greatest("_peak", last)).alias("peak"), (F.col("_made") + F.least("_low", last)).alias("low"), F.greatest("_fall", F.greatest("_peak", last) - last).alias("fall"),
        F.when(cut, on("_at")).alias("at_cut"), F.when(cut, on("_closed")).alias("closed"),
    )


def merged(parts: DataFrame, config: WalkForward, keys: list[str]) -> DataFrame:
    """(keys, fold, split, cand, trades, win_rate, profit_factor, total_pnl, sharpe, max_drawdown) of block_summaries().

    The training set of fold f is run 0 up to block f - 1, cut there. Peaks carry over from block to block; nothing is worked out from rows again.
    """
    ck = [*keys, "run", "cand"]
    peak = F.max(F.greatest("peak", "at_cut")).over(Window.partitionBy(*ck).orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    df = parts.withColumn("_before", peak)
    df = df.withColumns({"_top": F.greatest("_before", "peak"), "_body": F.greatest("fall", F.col("_before") - F.col("low"))})
    df = df.withColumns({"_on": F.greatest(F.col("_body"), F.greatest("_top", "at_cut") - F.col("at_cut")), "_cut": F.greatest(F.col("_body"), F.greatest("_top", "closed") - F.col("closed"))})
    trains = F.col("run") == 0
    df = df.withColumn("fold", F.explode(F.when(trains, F.sequence(F.col("block") + 1, F.lit(config.splits))).otherwise(F.array("run"))))
    ends = ~trains | (F.col("block") == F.col("fold") - 1)
    df = df.select(*keys, "fold", F.when(trains, "train").otherwise("test").alias("split"), "cand", F.when(ends, F.col("_cut")).otherwise(F.col("_on")).alias("_fall"), F.inline(F.array_compact(F.array("own", F.when(ends, F.col("forced"))))))
    got = df.groupBy(*keys, "fold", "split", "cand").agg(
        F.sum("n").alias("trades"), F.sum("wins").alias("_wins"), F.sum("gain").alias("_gain"), F.sum("loss").alias("_loss"), F.sum("total").alias("total_pnl"),
        F.max("_fall").alias("max_drawdown"), F.collect_list(F.struct("n", "mean", "var")).alias("_parts"),  # two for each chunk of a block at most
    )
    over = lambda f: F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + f(x))
    got = got.withColumn("_mean", F.try_divide(over(lambda x: x["n"] * x["mean"]), F.col("trades")))
    spread = over(lambda x: x["n"] * (x["var"] + (x["mean"] - F.col("_mean")) * (x["mean"] - F.col("_mean"))))
    got = got.withColumn("_std", F.sqrt(F.try_divide(spread, F.col("trades") - 1)))
    return got.withColumns({
        "win_rate": F.coalesce(F.try_divide("_wins", "trades"), F.lit(0.0)),
        "profit_factor": F.when(F.col("trades") == 0, 0.0).when(F.col("_loss") <= 1e-12, F.lit(float("inf"))).otherwise(F.try_divide("_gain", "_loss")),
        "sharpe": F.when((F.col("trades") > 1) & (F.col("_std") > 1e-12), F.try_divide("_mean", "_std")).otherwise(0.0),
    }).drop("_wins", "_gain", "_loss", "_parts", "_mean", "_std")


def walk_forward(df: DataFrame, config: WalkForward = WalkForward(), grid=GRID, keys: tuple[str, ...] = ("symbol",), price: str = "midprice", signal: str = "ofi_300s") -> tuple[DataFrame, DataFrame]:
    """(folds, summary): the candidate chosen in training and its test results by fold; totals and the stability gate by key."""
    require(df, price, signal, "seq", *keys)
    k = list(keys)
    check_sizes(df, config, max(n for _, _, n in grid), k)
    rows = blocks(df.select(*k, "seq", F.col(price).alias("price"), F.col(signal).cast("double").alias("_value")), config, k)
    parts = block_summaries(rows.select(*k, "seq", "price", "_value", "block", (F.col("block") == config.splits).alias("_last")), grid, config.cost_bps, k)
    full = merged(parts, config, k).join(F.broadcast(candidates(df.sparkSession, grid)), "cand")  # the grid is a short list
    order = Window.partitionBy(*k, "fold").orderBy(F.desc(F.round("total_pnl", 9)), F.desc(F.round("sharpe", 9)), F.round("max_drawdown", 9), "lookback", "cand")
    measures = {"test_pnl": "total_pnl", "test_trades": "trades", "test_win_rate": "win_rate", "test_profit_factor": "profit_factor", "test_max_drawdown": "max_drawdown"}
    tested = F.first(F.when(F.col("split") == "test", F.struct(*(F.col(c).alias(name) for name, c in measures.items()))), True).over(Window.partitionBy(*k, "fold", "cand"))
    out = full.withColumn("_test", tested).where("split = 'train'").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    sizes = df.groupBy(*k).agg(F.count("*").alias("_n")).withColumn("_size", F.floor(F.col("_n") / (config.splits + 1)).cast("long"))
    start = F.col("_n") + (F.col("fold") - 1 - config.splits) * F.col("_size")
    spans = sizes.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(config.splits)))).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(k)), F.col("fold").alias("_f"), start.alias("train_end"), start.alias("test_start"), (start + F.col("_size")).alias("test_end"))
    same = F.col("fold") == F.col("_f")
    for i, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(spans, same).select(*k, "fold", "cand", "entry", "exit", "lookback", F.col("total_pnl").alias("train_pnl"), "_test.*", "train_end", "test_start", "test_end", F.lit(config.cost_bps).alias("cost_bps"))
    return out, stability(out, config, k)


def stability(fold_rows: DataFrame, config: WalkForward, keys: list[str]) -> DataFrame:
    """Totals of the test results by key, their variation, and reasons against, in order."""
    s = fold_rows.groupBy(*keys).agg(
        F.sum("test_pnl").alias("total_pnl"), F.avg("test_pnl").alias("mean_pnl"), F.percentile("test_pnl", F.lit(0.5)).alias("median_pnl"), F.min("test_pnl").alias("worst_pnl"),
        F.stddev_samp("test_pnl").alias("std_pnl"), F.avg((F.col("test_pnl") > 0).cast("double")).alias("profitable_ratio"), F.sum("test_trades").alias("total_trades"),
    )
    s = s.withColumn("cv", F.try_divide(F.col("std_pnl"), F.abs(F.nullif("mean_pnl", F.lit(0.0)))))
    gains = (F.col("total_pnl") > 0) & (F.col("median_pnl") > 0)
    stable = (F.col("profitable_ratio") >= config.least_ratio) & F.coalesce(F.col("cv") <= config.most_cv, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~gains, "not_profitable_after_costs"),
            F.when(F.col("profitable_ratio") < config.least_ratio, "inconsistent_fold_profitability"),
            F.when(~F.coalesce(F.col("cv") <= config.most_cv, F.lit(False)), "excessive_pnl_dispersion"),
        )
    )
    return s.withColumns({"profitable": gains, "stable": stable, "passed": gains & stable, "reasons": reasons})
