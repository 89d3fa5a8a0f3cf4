"""Rolling estimators by symbol in order of arrival, as a scan over chunks of each symbol's rows.

What an estimator knows of the past is a few numbers and the last rows of its window. So a symbol's rows are cut into chunks
of thousands; every chunk is summed up on its own (`part`), the small parts are joined in order (`join`), and every chunk is
worked out from the state before it (`run`): one symbol fills as many cores as it has chunks. A chunk's rows are one Arrow group,
bounded by `MOST` rows and a bucket of the order of arrival; the functions are those of `functions.rolling`, over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions import rolling
from tidebook.operators import books

WINDOWS = (60, 300, 900)
#: Rows of a chunk, at least and at most, about; in between a symbol has SHARE chunks. Places of a bucket of `seq`.
LEAST, MOST, SHARE, BUCKET = 4096, 1 << 18, 64, 8192


def by():
    return Window.partitionBy("symbol").orderBy("seq")


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return by().rowsBetween(Window.unboundedPreceding, -1)


def sign_of(change: Column) -> Column:
    return F.when(change > 0, 1).when(change < 0, -1)


def tick_rule(df: DataFrame, name: str, valid: Column) -> DataFrame:
    """Adds the sign of the last change of `ltp` among valid rows; 0 before any, null on other rows."""
    df = df.withColumn("_tp", F.when(valid, F.col("ltp"))).withColumn("_tq", F.last("_tp", True).over(before()))
    df = df.withColumn("_tm", sign_of(F.col("_tp") - F.col("_tq")))
    return df.withColumn(name, F.when(valid, F.coalesce(F.last("_tm", True).over(so_far()), F.lit(0)))).drop("_tp", "_tq", "_tm")


def finite(c: Column) -> Column:
    """Whether a price is a finite number above 0 (NaN is above infinity in Spark's order); null counts as no."""
    return F.coalesce((c > 0) & (c < float("inf")), F.lit(False))


# the scan

#: What the estimators call the columns that they read.
NAMES = {"_day": "day", "bid_px_1": "bid", "bid_qty_1": "bid_qty", "ask_px_1": "ask", "ask_qty_1": "ask_qty"}
LONGS = ("island", "dvol", "cum_delta", "tick_volume")


def chunked(df: DataFrame) -> DataFrame:
    """Adds `_chunk`: consecutive rows of a symbol, by counts of its rows in buckets of `seq`."""
    bucket = F.floor(F.col("seq") / BUCKET)
    n = df.select(F.col("symbol").alias("_s"), bucket.alias("_b")).groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    width = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.sum("_n").over(Window.partitionBy("_s")) / SHARE)))
    place = n.select("_s", "_b", F.floor(upto / width).alias("_chunk"))
    return df.join(place, F.col("symbol").eqNullSafe(F.col("_s")) & (bucket == F.col("_b"))).drop("_s", "_b")


def arrays(t: pa.Table | pa.RecordBatch, order: np.ndarray) -> rolling.Rows:
    """Columns as doubles in order of arrival, null as nan."""
    out = {}
    for name in t.schema.names:
        kind = t.schema.field(name).type
        if name != "seq" and (pa.types.is_floating(kind) or pa.types.is_integer(kind)):
            out[NAMES.get(name, name)] = np.asarray(t.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False))[order]
    return out


def scan(df: DataFrame, estimators: dict[str, object]) -> DataFrame:
    """df with the fields of all estimators (by name; see functions.rolling) of each row, from its symbol's rows up to it."""
    longs = {"symbol", "seq"}
    rows = chunked(df.withColumn("_day", F.unix_date(F.to_date("ts"))) if "ts" in df.columns else df.withColumn("_day", F.lit(0)))
    names = list(estimators)
    fields = [f for e in estimators.values() for f in e.fields]
    assert longs <= set(df.columns)
    groups = rows.groupBy("symbol", "_chunk")

    def part(key: tuple, t: pa.Table) -> pa.Table:
        r = arrays(t, np.argsort(t.column("seq").to_numpy(), kind="stable"))
        return pa.table({"symbol": pa.array([key[0].as_py()], pa.string()), "_chunk": pa.array([key[1].as_py()], pa.int64())} | {f"_{k}": pa.array([estimators[k].part(r)], pa.list_(pa.float64())) for k in names})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states before chunks, from parts in order; the state moves from batch to batch and is all that is kept."""
        symbol, states = object(), {}
        for b in batches:
            out = {k: [] for k in names}
            of, parts = b.column("symbol").to_pylist(), {k: b.column(f"_{k}") for k in names}
            for i, s in enumerate(of):
                if s != symbol:
                    symbol, states = s, {k: rolling.NONE for k in names}
                for k in names:
                    out[k].append(states[k])
                    states[k] = estimators[k].join(states[k], parts[k][i].values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("_chunk"), *(pa.array(out[k], pa.list_(pa.float64())) for k in names)], names=["symbol", "_chunk", *(f"_{k}" for k in names)])

    def run(key: tuple, t: pa.Table, state: pa.Table) -> pa.Table:
        order = np.argsort(t.column("seq").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        r = arrays(t, np.arange(len(order)))
        for k in names:
            old = state.column(f"_{k}").combine_chunks()[0].values.to_numpy(zero_copy_only=False)
            for f, v in zip(estimators[k].fields, estimators[k].run(old, r)):
                v = pa.array(v, from_pandas=True)
                t = t.append_column(f, v.cast(pa.int64()) if f in LONGS else v)
        return t.drop_columns(["_chunk", "_day"])

    kind = "symbol string, _chunk long, " + ", ".join(f"_{k} array<double>" for k in names)
    parts = groups.applyInArrow(part, kind)
    states = parts.repartition("symbol").sortWithinPartitions("symbol", "_chunk").mapInArrow(joined, kind)
    out = T.StructType(df.schema.fields + [T.StructField(f, T.LongType() if f in LONGS else T.DoubleType()) for f in fields])
    return groups.cogroup(states.groupBy("symbol", "_chunk")).applyInArrow(run, out)


def added(df: DataFrame, estimators: dict[str, object], *drop: str) -> DataFrame:
    """scan() of the columns that the estimators read, without fields of those names in df."""
    fields = [f for e in estimators.values() for f in e.fields]
    return scan(df.drop(*fields), estimators).drop(*drop)


def order_flow(ticks: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Adds `ofi` (the event) and `ofi_<w>s` for windows in seconds, the current instant and exactly w ago included."""
    top = ["bid_px_1", "bid_qty_1", "ask_px_1", "ask_qty_1"]
    two = F.lit(True)
    for c in top:
        two = two & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # the event alone needs one row before: a window costs less here than a scan's passes
    df = ticks.withColumn("_prev", F.last(F.when(two, F.struct(*top)), True).over(before()))
    (b, q, a, z), (pb, pq, pa_, pz) = ([F.col(f"{p}{c}") for c in top] for p in ("", "_prev."))
    bid = F.when(b > pb, q).when(b == pb, q - pq).otherwise(-pq)
    ask = F.when(a < pa_, -z).when(a == pa_, pz - z).otherwise(pz)
    df = df.withColumn("ofi", F.when(two & F.col("_prev").isNotNull(), bid + ask).otherwise(0).cast("double")).drop("_prev")
    return flow_sums(df, windows)


def flow_sums(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Adds `ofi_<w>s`: sums of `ofi` by time, over a symbol's stretches of the longest window.

    Each row goes to its own stretch and, with its time and event alone, to the next one; a window ends in the stretch where it
    begins or the one after. Sums are differences of running sums, exact since events are whole numbers.
    """
    if "us" not in df.columns:
        df = df.withColumn("us", F.unix_micros("ts"))
    if not windows:
        return df
    span = max(windows) * 1_000_000 + 1
    again = F.explode(F.when(F.col("us").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    df = df.withColumn("_again", again)
    own = F.col("_again") == 0
    df = df.select(F.floor(F.col("us") / span).alias("_stretch") + F.col("_again"), "_again", "symbol", "us", "ofi", *(F.when(own, F.col(c)).alias(c) for c in df.columns if c not in ("_again", "symbol", "us", "ofi")))
    df = df.withColumnRenamed(df.columns[0], "_stretch")
    upto = lambda us: F.coalesce(F.sum("ofi").over(Window.partitionBy("symbol", "_stretch").orderBy("us").rangeBetween(Window.unboundedPreceding, us)), F.lit(0.0))
    return df.withColumns({f"ofi_{w}s": upto(0) - upto(-w * 1_000_000 - 1) for w in windows}).where("_again = 0").drop("_again", "_stretch")


def sessions(ticks: DataFrame) -> DataFrame:
    """Adds the session's number, traded volume `dvol` (null where price or volume are unknown), vwap, vwap_stdev, vwap_dev and cum_delta."""
    return added(ticks, {"session": rolling.Session()})


def volume_profile(ticks: DataFrame, bucket: float = 0.5) -> DataFrame:
    """(symbol, bucket, qty) of each symbol's current session."""
    df = sessions(ticks)
    newest = df.groupBy("symbol").agg(F.max("island").alias("_now"))  # two small aggregates instead of a window over all rows
    trades = df.where("dvol > 0").withColumn("bucket", F.round(F.floor(F.col("ltp") / bucket) * bucket, 4))
    sums = trades.groupBy("symbol", "island", "bucket").agg(F.sum("dvol").cast("long").alias("qty"))
    return sums.join(newest, "symbol").where(F.col("island") == F.col("_now")).select("symbol", "bucket", "qty")


def profile_map(profile: DataFrame) -> DataFrame:
    """(symbol, profile): the map in order of the price."""
    return profile.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "qty")))).alias("profile"))


def kyle(df: DataFrame, window: int = 300, least: int = 30) -> DataFrame:
    """Adds kyle_lambda, kyle_r2, kyle_t_stat: mid returns (bps) on signed trade sizes. Needs `midprice`."""
    return added(df, {"kyle": rolling.Kyle(window, least)})


def amihud(df: DataFrame, window: int = 300) -> DataFrame:
    """Adds amihud_illiq: the mean of |mid return| over traded money, per million."""
    return added(df, {"amihud": rolling.Amihud(window)})


def roll(df: DataFrame, window: int = 200, least: int = 30) -> DataFrame:
    """Adds roll_serial_cov and roll_spread_bps from the serial covariance of price changes."""
    return added(df, {"roll": rolling.Roll(window, least)})


def variance_share(df: DataFrame, window: int = 500, least: int = 50) -> DataFrame:
    """Adds trade_variance_share and avg_signed_trade_return_bps."""
    return added(df, {"share": rolling.Share(window, least)})


def tick_volume(df: DataFrame) -> DataFrame:
    """Adds tick_volume: the rise of the last known cumulative volume, never below 0; 0 at first; null without volume."""
    return added(df, {"rises": rolling.Rises()})


def score_estimators(window: int = 300, given: bool = False) -> dict[str, object]:
    """Estimators of z_spread, z_volume and z_ofi; given: `ofi` is a column already."""
    flow = rolling.Scores("ofi", "z_ofi", window) if given else rolling.ScoresOf(rolling.Flow(), "z_ofi", window)
    return {"z_spread": rolling.Scores("spread", "z_spread", window), "z_volume": rolling.ScoresOf(rolling.Rises(), "z_volume", window), "z_ofi": flow}


def zscores(df: DataFrame, window: int = 300) -> DataFrame:
    """Adds tick_volume, z_spread, z_volume and z_ofi, and `ofi` where df has none: values against the `window` ones before. Needs `spread`."""
    return added(df, score_estimators(window, "ofi" in df.columns))


def anomalies(df: DataFrame, window: int = 300, threshold: float = 3.0) -> DataFrame:
    """(symbol, seq, ts, kind, severity, detail) in order spread, volume, flow for each tick. Needs `spread`."""

    def alert(place, kind, fires, z, *detail):
        severity = F.when(F.abs(z) < 1.5 * threshold, "warn").otherwise("critical")
        entries = [x for name, v in detail for x in (F.lit(name), v.cast("double"))]
        return F.when(fires, F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), severity.alias("severity"), F.create_map(*entries, F.lit("zscore"), F.round(z, 2)).alias("detail")))

    z = zscores(df, window)
    found = F.array_compact(
        F.array(
            alert(0, "spread_blowup", F.col("z_spread") > threshold, F.col("z_spread"), ("spread", F.col("spread"))),
            alert(1, "volume_spike", F.col("z_volume") > threshold, F.col("z_volume"), ("tick_volume", F.col("tick_volume"))),
            alert(2, "ofi_extreme", F.abs("z_ofi") > threshold, F.col("z_ofi"), ("ofi", F.round("ofi", 2))),
        )
    )
    return z.select("symbol", "seq", "ts", F.inline(found)).select("symbol", "seq", "ts", "place", "kind", "severity", "detail")


def metrics_input(ticks: DataFrame) -> DataFrame:
    """Flat ticks with spreads, as the estimators and alerts take them."""
    return books.spreads(ticks)


def metrics_estimators() -> dict[str, object]:
    return {"flow": rolling.Flow(), "session": rolling.Session(), "kyle": rolling.Kyle(), "amihud": rolling.Amihud(), "roll": rolling.Roll(), "share": rolling.Share()}


def metrics(ticks: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """All estimators of every tick, from one scan; sums of order flow by time after it."""
    df = metrics_input(ticks)
    if "us" not in df.columns:
        df = df.withColumn("us", F.unix_micros("ts"))
    # deeper levels are in the spreads by now: narrow rows
    df = df.select("seq", "us", "ts", "symbol", "ltp", "ltq", "volume", "bid_px_1", "bid_qty_1", "ask_px_1", "ask_qty_1", "midprice", "spread", "relative_spread", "weighted_spread")
    df = scan(df, metrics_estimators()).drop("bid_px_1", "bid_qty_1", "ask_px_1", "ask_qty_1", "ltq", "volume", "island", "dvol")
    df = flow_sums(df, windows)
    names = ["symbol", "ltp", "midprice", "spread", "relative_spread", "weighted_spread", *(f"ofi_{w}s" for w in windows), "vwap", "vwap_dev", "vwap_stdev", "cum_delta", "kyle_lambda", "kyle_r2", "kyle_t_stat"]
    names += ["amihud_illiq", "roll_spread_bps", "roll_serial_cov", "trade_variance_share", "avg_signed_trade_return_bps"]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx").alias("timestamp")
    return df.select("seq", "us", names[0], stamp, *names[1:])
