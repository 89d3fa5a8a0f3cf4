"""Snapshots, their flat form, and spreads: projections in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.schema import DEPTH


def flatten(snapshots: DataFrame) -> DataFrame:
    """Nested book to wide columns; levels that are missing are null."""
    cols = {f"{side}_{col}_{i}": F.get(F.col(f"{side}s"), i - 1)[field] for i in range(1, DEPTH + 1) for side in ("bid", "ask") for col, field in (("px", "price"), ("qty", "qty"))}
    return snapshots.select(*(c for c in snapshots.columns if c not in ("bids", "asks")), *(v.alias(k) for k, v in cols.items()))


def nest(ticks: DataFrame) -> DataFrame:
    """Wide columns to a nested book; levels without price are left out; orders are unknown (0)."""
    level = lambda side, i: F.struct(F.col(f"{side}_px_{i}").alias("price"), F.col(f"{side}_qty_{i}").cast("long").alias("qty"), F.lit(0).alias("orders"))
    book = lambda side: F.filter(F.array(*(level(side, i) for i in range(1, DEPTH + 1))), lambda x: x["price"].isNotNull())
    wide = {f"{side}_{col}_{i}" for i in range(1, DEPTH + 1) for side in ("bid", "ask") for col in ("px", "qty")}
    return ticks.select(*(c for c in ticks.columns if c not in wide), book("bid").alias("bids"), book("ask").alias("asks"))


def snapshot_json(snapshots: DataFrame) -> DataFrame:
    """(symbol, seq, json): what the latest-value store keeps."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx")
    return snapshots.select("symbol", "seq", F.to_json(F.struct("symbol", at.alias("ts"), "bids", "asks", "ltp", "ltq", "volume"), {"ignoreNullFields": "false"}).alias("json"))


def midprice() -> Column:
    return (F.col("bid_px_1") + F.col("ask_px_1")) / 2


def quoted_spread() -> Column:
    return F.col("ask_px_1") - F.col("bid_px_1")


def relative_spread() -> Column:
    return F.try_divide(quoted_spread(), F.nullif(midprice(), F.lit(0.0)))


def weighted_spread(depth: int = DEPTH) -> Column:
    """Quantity-weighted mean ask less mean bid; null without quantity on a side. Unrolled, so that it stays in generated code."""

    def mean(side: str) -> Column:
        there = [(F.col(f"{side}_px_{i}"), F.col(f"{side}_qty_{i}")) for i in range(1, min(depth, DEPTH) + 1)]
        money = reduce(lambda a, b: a + b, (F.coalesce(p * q, F.lit(0.0)) for p, q in there))
        size = reduce(lambda a, b: a + b, (F.when(p.isNotNull(), F.coalesce(q, F.lit(0))).otherwise(0) for p, q in there))
        return F.try_divide(money, F.nullif(size, F.lit(0)))

    return mean("ask") - mean("bid")


def spreads(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({"midprice": midprice(), "spread": quoted_spread(), "relative_spread": relative_spread(), "weighted_spread": weighted_spread()})


def depth_share(ticks: DataFrame) -> DataFrame:
    """Each level's quantity as a share of the largest on either side (at least 1), for drawing a book."""
    sizes = [F.col(f"{s}_qty_{i}") for i in range(1, DEPTH + 1) for s in ("bid", "ask")]
    top = F.greatest(F.lit(1), *(F.coalesce(x, F.lit(0)) for x in sizes))
    out = [F.struct(F.lit(s).alias("side"), F.lit(i).alias("level"), (F.coalesce(F.col(f"{s}_qty_{i}"), F.lit(0)) / top).alias("share")) for i in range(1, DEPTH + 1) for s in ("bid", "ask")]
    return ticks.select("symbol", "seq", F.inline(F.array(*out)))


def signed_split(df: DataFrame, column: str) -> DataFrame:
    """Adds `<column>_pos` (>= 0) and `<column>_neg` (< 0), null where the other holds."""
    c = F.col(column)
    return df.withColumns({f"{column}_pos": F.when(c >= 0, c), f"{column}_neg": F.when(c < 0, c)})
