"""TWAP and VWAP schedules and their simulation against recorded books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.schema import DEPTH, require

KEYS = ("symbol",)


def indexed(ticks: DataFrame, keys=KEYS) -> DataFrame:
    """Adds `i` (0-based place) and `n` (rows of the key)."""
    by = Window.partitionBy(*keys).orderBy("seq")
    return ticks.withColumns({"i": F.row_number().over(by) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})


def slices(counts: DataFrame, slices: int, keys=KEYS) -> DataFrame:
    """(keys, n, eff, j, i): evenly spaced places of the child orders, from (keys, n)."""
    eff = F.least(F.lit(slices), F.col("n")).cast("int")
    each = counts.withColumn("eff", eff).where("eff > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("eff") - 1)).alias("j"))
    step = (F.col("n") - 1).cast("double") / F.nullif(F.col("eff") - 1, F.lit(0))
    place = F.when(F.col("eff") == 1, 0).when(F.col("j") == F.col("eff") - 1, F.col("n") - 1).otherwise(F.floor(F.col("j") * step))
    return each.withColumn("i", place.cast("long"))


def twap(counts: DataFrame, target: Column, parts: int = 10, keys=KEYS) -> DataFrame:
    """(keys, j, i, child): equal children, the last takes the remainder; empty ones are left out."""
    s = slices(counts, parts, keys)
    share = F.floor(target / F.col("eff")).cast("long")
    return s.withColumn("child", F.when(F.col("j") == F.col("eff") - 1, target - share * (F.col("eff") - 1)).otherwise(share).cast("long")).where("child > 0").select(*keys, "j", "i", "child")


def vwap(ticks_indexed: DataFrame, target: Column, parts: int = 10, keys=KEYS, orders: DataFrame | None = None) -> DataFrame:
    """(keys, j, i, child): children in proportion to the volume around their place; the last takes the remainder.

    With orders (a short table whose columns `target` may use) a schedule for each; their columns become keys.
    """
    counts = ticks_indexed.select(*keys, "n").distinct()
    s = slices(counts, parts, keys)
    after = Window.partitionBy(*keys).orderBy("j")
    edge = F.floor((F.col("i") + F.lead("i").over(after)) / 2).cast("long")
    s = s.withColumns({"_to": F.coalesce(edge, F.col("n"))}).withColumn("_from", F.coalesce(F.lag("_to").over(after), F.lit(0).cast("long")))
    dv = ticks_indexed.withColumn("_d", F.greatest(F.lit(0), F.coalesce(F.col("volume") - F.lag("volume").over(Window.partitionBy(*keys).orderBy("seq")), F.lit(0))))
    # running sums, looked up at the edges: an equi-join instead of a range join
    sums = dv.select(*keys, (F.col("i") + 1).cast("long").alias("_at"), F.sum("_d").over(Window.partitionBy(*keys).orderBy("seq")).alias("_sum"))
    look = lambda d, at, name: d.join(sums.select(*keys, F.col("_at").alias(at), F.col("_sum").alias(name)), [*keys, at], "left")
    s = look(look(s, "_to", "_hi"), "_from", "_lo").withColumn("_v", F.coalesce("_hi", F.lit(0)) - F.coalesce("_lo", F.lit(0)))
    if orders is not None:
        s, keys = s.crossJoin(F.broadcast(orders)), (*keys, *orders.columns)
        after = Window.partitionBy(*keys).orderBy("j")
    total = F.sum("_v").over(Window.partitionBy(*keys))
    s = s.withColumn("_w", F.when(total > 0, F.col("_v") / F.nullif(total, F.lit(0))).otherwise(F.lit(1.0) / F.col("eff")))
    s = s.withColumn("_c", F.floor(target * F.col("_w")).cast("long"))
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    left = (target - F.coalesce(F.sum("_c").over(before), F.lit(0))).cast("long")
    s = s.withColumn("child", F.when(F.col("j") == F.col("eff") - 1, left).otherwise(F.least(F.col("_c"), left)).cast("long"))
    return s.where("child > 0").select(*keys, "j", "i", "child")


def walk_book(df: DataFrame, qty: Column, side: str = "buy") -> DataFrame:
    """Adds `filled` and `cost`: what five levels of the other side give for qty; levels without price or size are skipped."""
    s = "ask" if side == "buy" else "bid"
    sizes = []
    for k in range(1, DEPTH + 1):
        px, sz = F.col(f"{s}_px_{k}"), F.col(f"{s}_qty_{k}")
        ok = px.isNotNull() & ~F.isnan(px) & (F.abs(px) != float("inf")) & (sz > 0)
        sizes.append((F.when(ok, px).otherwise(0.0), F.when(ok, sz).otherwise(0)))
    filled, cost, taken = F.lit(0), F.lit(0.0), F.lit(0)
    for px, sz in sizes:
        got = F.greatest(F.lit(0), F.least(sz, qty - taken))
        filled, cost, taken = filled + got, cost + got * px, taken + sz
    return df.withColumns({"filled": filled.cast("long"), "cost": cost})


def session_vwap(ticks: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, vwap): mean ltp by ltq, by the rise of volume (at least 1) where that is null; the plain mean without quantity."""
    by = Window.partitionBy(*keys).orderBy("seq")
    q = F.coalesce(F.col("ltq"), F.greatest(F.lit(1), F.coalesce(F.col("volume") - F.lag("volume").over(by), F.lit(1))))
    df = ticks.withColumn("_q", q)
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("ltp") * F.col("_q")), F.nullif(F.sum("_q"), F.lit(0))), F.avg("ltp")).alias("vwap"))


def simulations(ticks: DataFrame, kinds: list[str], targets: list[int], parts: int = 10, side: str = "buy", keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """(fills, summary) of orders of each kind of schedule and quantity on each key's ticks, all from one numbering of the ticks."""
    require(ticks, "seq", "ltp", "volume", *keys, *(f"{s}_{c}_{i}" for i in range(1, DEPTH + 1) for s in ("bid", "ask") for c in ("px", "qty")))
    if ticks.isEmpty():
        raise ValueError("at least one tick is needed")
    at = indexed(ticks, keys)
    orders = ticks.sparkSession.createDataFrame([(int(q),) for q in targets], "target_qty long")  # a short list
    own = [*keys, "target_qty"]
    counts = at.select(*keys, "n").distinct().crossJoin(F.broadcast(orders))
    plans = {"twap": lambda: twap(counts, F.col("target_qty"), parts, own), "vwap": lambda: vwap(at, F.col("target_qty"), parts, keys, orders)}
    plan = reduce(DataFrame.unionByName, [plans[k]().withColumn("strategy", F.lit(k)) for k in kinds])
    mid = (F.col("bid_px_1") + F.col("ask_px_1")) / 2
    arrival = at.where("i = 0").select(*keys, mid.alias("arrival"))
    sign = 1 if side == "buy" else -1
    hit = walk_book(plan.join(at.withColumn("i", F.col("i").cast("long")), [*keys, "i"]), F.col("child"), side).join(arrival, list(keys))
    px = F.try_divide(F.col("cost"), F.nullif("filled", F.lit(0)))
    bps = lambda p, ref: sign * (p - ref) / ref * 1e4
    fills = hit.where("filled > 0").select(*own, "strategy", F.col("i").alias("tick_idx"), F.col("filled").alias("qty"), px.alias("price"), bps(px, F.col("arrival")).alias("slip_bps"), "cost")
    done = fills.groupBy(*own, "strategy").agg(F.sum("qty").alias("filled_qty"), F.sum("cost").alias("_cost"), F.max_by("slip_bps", "tick_idx").alias("last_slip"))
    each = orders.crossJoin(ticks.sparkSession.createDataFrame([(k,) for k in kinds], "strategy string"))
    s = arrival.join(session_vwap(ticks, keys), list(keys)).crossJoin(F.broadcast(each)).join(done, [*own, "strategy"], "left").withColumn("avg", F.try_divide("_cost", "filled_qty"))
    summary = s.select(
        *keys, "strategy", "target_qty", F.coalesce("filled_qty", F.lit(0)).cast("long").alias("filled_qty"),
        F.coalesce("avg", F.lit(float("nan"))).alias("avg_fill_price"), F.col("arrival").alias("arrival_price"), F.col("vwap").alias("session_vwap"),
        bps(F.col("avg"), F.col("arrival")).alias("implementation_shortfall_bps"), bps(F.col("avg"), F.col("vwap")).alias("vwap_slippage_bps"), F.col("last_slip").alias("market_impact_bps"),
    )
    return fills.drop("cost"), summary


def simulate(ticks: DataFrame, kind: str, target: int, parts: int = 10, side: str = "buy", keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """(fills, summary) of an order executed by a schedule on each key's ticks."""
    fills, summary = simulations(ticks, [kind], [target], parts, side, keys)
    return fills.drop("strategy", "target_qty"), summary


def compare(ticks: DataFrame, targets: list[int], parts: int = 10, side: str = "buy", keys=KEYS) -> DataFrame:
    """Summaries of both strategies for each quantity."""
    return simulations(ticks, ["twap", "vwap"], targets, parts, side, keys)[1]
