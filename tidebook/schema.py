"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DEPTH = 5
LEVEL = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("qty", T.LongType()), T.StructField("orders", T.IntegerType())])
#: A snapshot; seq is the order of arrival.
SNAPSHOT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("bids", T.ArrayType(LEVEL)),
        T.StructField("asks", T.ArrayType(LEVEL)),
        T.StructField("ltp", T.DoubleType()),
        T.StructField("ltq", T.LongType()),
        T.StructField("volume", T.LongType()),
    ]
)
LEVEL_COLUMNS = [f"{side}_{what}_{i}" for i in range(1, DEPTH + 1) for side in ("bid", "ask") for what in ("px", "qty")]
#: The flat form on disk, in its column order.
TICK = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("symbol", T.StringType()), T.StructField("ltp", T.DoubleType()), T.StructField("ltq", T.LongType()), T.StructField("volume", T.LongType())]
    + [T.StructField(c, T.DoubleType() if "_px_" in c else T.LongType()) for c in LEVEL_COLUMNS]
)
#: Ticks as CSV: the first column is an ISO-8601 string.
CSV_TICK = T.StructType([T.StructField("timestamp", T.StringType()), *TICK.fields[1:]])
TRADE = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("price", T.DoubleType()), T.StructField("qty", T.LongType()), T.StructField("side", T.StringType())])
ANOMALY = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("detail", T.MapType(T.StringType(), T.DoubleType()))]
)
#: The 22 fields of a metrics record, in order.
METRICS = (
    "symbol timestamp ltp midprice spread relative_spread weighted_spread ofi_60s ofi_300s ofi_900s vwap vwap_dev vwap_stdev cum_delta "
    "kyle_lambda kyle_r2 kyle_t_stat amihud_illiq roll_spread_bps roll_serial_cov trade_variance_share avg_signed_trade_return_bps"
).split()
MODULES = ("spread", "ofi", "vwap", "volume", "kyle", "amihud", "roll", "trade_quote", "anomaly")
LATENCY = T.StructType([T.StructField("tick_id", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("total_us", T.DoubleType()), *(T.StructField(f"{m}_us", T.DoubleType()) for m in MODULES), T.StructField("overhead_us", T.DoubleType())])


def require(df, *columns: str) -> None:
    """Raise ValueError naming the columns that df lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
