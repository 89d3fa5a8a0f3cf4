"""Research analytics: distributions, correlations, regressions, histograms, as-of joins, profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.stats import pearson_p


def describe(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """count, mean, sample std, min, exact quartiles (interpolated), max by key."""
    c = F.col(column)
    got = df.groupBy(*keys).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return beside(got, quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, *keys).drop("n"), *keys).select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def beside(df: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """df with the columns of another table that has a row for each of the same keys."""
    if not keys:
        return df.crossJoin(more)  # one row each
    named = more.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*(f"_k_{k}" for k in keys))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def first_seen(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Distinct keys in order of first appearance."""
    return df.groupBy(key).agg(F.min("seq").alias("first_seq")).orderBy("first_seq")


def cut(df: DataFrame, column: str, bins: int, value: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bin, total): sums of `value` over equal bins of a column, closed on the right, the lowest taking the minimum too; empty bins left out."""
    span = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.try_divide(F.col(column) - F.col("_lo"), F.nullif(width, F.lit(0.0))))))
    return df.join(F.broadcast(span) if not keys else span, list(keys)).groupBy(*keys, F.coalesce(place, F.lit(1)).cast("long").alias("bin")).agg(F.sum(value).cast("long").alias("total"))


def histogram(df: DataFrame, column: str, bins: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, bin, n, density): counts over equal bins closed on the left, the last on both sides."""
    rows = df.where(F.col(column).isNotNull())
    span = rows.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - F.col("_lo"), F.nullif(width, F.lit(0.0)))))
    got = rows.join(span, list(keys)).groupBy(*keys, F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("_n").alias("_n"), F.first(width).alias("_w"))
    return got.select(*keys, "bin", "n", F.try_divide(F.col("n"), F.col("_n") * F.nullif("_w", F.lit(0.0))).alias("density"))


def boxplot(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Quartiles and the farthest values within 1.5 interquartile ranges."""
    q = quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *keys).drop("n")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(column) >= F.col("q1") - 1.5 * iqr) & (F.col(column) <= F.col("q3") + 1.5 * iqr)
    return df.join(q, list(keys)).groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("low"), F.max(F.when(inside, F.col(column))).alias("high"))


def moments(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    got = df.groupBy(*keys).agg(F.count(column).cast("double").alias("_n"), F.skewness(column).alias("_g1"), F.kurtosis(column).alias("_g2"))
    n = F.col("_n")
    return got.select(*keys, (F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"))


def correlation(df: DataFrame, x: str, y: str, *keys: str, least: int = 30) -> DataFrame:
    """(keys, n, corr, p_value) on rows with both; needs more than `least` of them."""
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("corr")).where(F.col("n") > least)
    return got.withColumn("p_value", pearson_p(F.col("corr"), F.col("n")))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, on rows that have all of them."""
    rows = df.dropna(subset=columns)
    pairs = list(combinations(columns, 2))
    got = rows.agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return got.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))))


def trend(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Least squares line with r² and the p-value of its slope."""
    got = df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("_r"))
    return got.select(*keys, "n", "slope", "intercept", (F.col("_r") * F.col("_r")).alias("r2"), pearson_p(F.col("_r"), F.col("n")).alias("p_value"))


def autocorrelation(df: DataFrame, column: str, lags: int = 40, keys: tuple[str, ...] = ("symbol",), least: int = 100) -> DataFrame:
    """(keys, lag, acf, band) of non-zero values, if more than `least`; band: 1.96 of Bartlett's deviation."""
    by = Window.partitionBy(*keys).orderBy("seq")
    rows = df.where(F.col(column).isNotNull() & (F.col(column) != 0))
    rows = rows.withColumns({"_m": F.avg(column).over(Window.partitionBy(*keys)), "_n": F.count("*").over(Window.partitionBy(*keys))}).where(F.col("_n") > least)
    rows = rows.withColumn("_d", F.col(column) - F.col("_m"))
    rows = rows.withColumns({f"_l{k}": F.col("_d") * F.lag("_d", k).over(by) for k in range(1, lags + 1)})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *(F.sum(f"_l{k}").alias(f"_s{k}") for k in range(1, lags + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)), F.nullif("_v", F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)))
    flat = sums.select(*keys, "_n", F.inline(each))
    before = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    var = (1 + 2 * F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))) / F.col("_n")
    return flat.select(*keys, "lag", "acf", (1.959963984540054 * F.sqrt(var)).alias("band"))


#: Width of the chunks of a key that the as-of join takes apart, in the unit of its column: a day in microseconds.
AS_OF_CHUNK = 86_400_000_000


def as_of(left: DataFrame, right: DataFrame, on: str, keys: list[str], values: list[str], direction: str = "nearest", chunk: int = AS_OF_CHUNK, ties: str | None = None) -> DataFrame:
    """left with the values of the right row of the same key that is nearest (backward on ties), at or before, or at or after.

    Both sides in one exchange by key and chunk of `on`, so that a hot key is many tasks. Within a chunk the last right row
    before and the first one after are carried along by two running windows, one for each direction; a chunk's edges are
    carried over the key's chunks, a few rows, and joined in the same partitioning. No row pairs are made.
    All left rows stay; those without a time have no match, and right ones without a time are none. Of right rows of one
    time the one with the largest `ties` (a column of right; without it the largest values, in their order) stands for
    all, in every direction.
    """
    rest = [c for c in left.columns if c not in (*keys, on)]
    rank = F.struct(*([ties] if ties else []), *values)
    hit = F.struct(F.col(on).alias("at"), *values)
    one = right.where(F.col(on).isNotNull()).groupBy(*keys, on).agg(F.max_by(F.struct(*values), rank).alias("_v"))
    one = one.select(*keys, on, *(F.col(f"_v.{v}").alias(v) for v in values))
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    l = left.select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), none(one, hit).alias("_hit"))  # noqa: E741
    r = one.select(*keys, F.col(on).alias("_t"), F.lit(0).alias("_side"), none(left, F.struct(*rest)).alias("_row"), hit.alias("_hit"))
    own = [*keys, "_chunk"]
    # rows without a time are dealt out by what they hold: they need nothing of each other
    both = l.unionAll(r).withColumn("_chunk", F.coalesce(F.floor(F.col("_t") / chunk), -1 - F.pmod(F.xxhash64("_row"), F.lit(1024)) - (1 << 62))).repartition(*own)
    there = F.when(F.col("_hit").isNotNull(), F.col("_t"))
    edges = both.groupBy(*own).agg(F.max_by("_hit", there).alias("_last"), F.min_by("_hit", there).alias("_first"))
    chunks = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*own, F.last("_last", True).over(chunks(F.col("_chunk"))).alias("_before"), F.last("_first", True).over(chunks(F.desc("_chunk"))).alias("_after"))
    so_far = lambda *order: F.last("_hit", True).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = so_far("_t", "_side"), so_far(F.desc("_t"), F.desc("_side"))
    both = both.join(edges.withColumnsRenamed({k: f"_{k}_" for k in own}), [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in own], "left")
    both = both.withColumns({"_b": F.coalesce(back, "_before"), "_f": F.coalesce(ahead, "_after")})
    same = F.col("_b.at") == F.col("_t")
    after = F.when(same, F.col("_b")).otherwise(F.col("_f"))
    gap = lambda h: F.abs(h["at"] - F.col("_t"))
    near = F.when(F.col("_f").isNull() | (gap(F.col("_b")) <= gap(F.col("_f"))), F.col("_b")).otherwise(F.col("_f"))
    pick = {"backward": F.col("_b"), "forward": after, "nearest": near}[direction]
    return both.where("_side = 1").withColumn("_p", F.when(F.col("_t").isNotNull(), pick)).select(*keys, F.col("_t").alias(on), *(F.col(f"_row.{c}").alias(c) for c in rest), *(F.col(f"_p.{v}").alias(v) for v in values))


def aligned(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows of both by their place within the key; columns of the right one other than keys are kept if new."""
    by = Window.partitionBy(*keys).orderBy("seq")
    r = right.withColumn("_i", F.row_number().over(by)).select(*keys, "_i", *(c for c in right.columns if c not in left.columns))
    return left.withColumn("_i", F.row_number().over(by)).join(r, [*keys, "_i"]).drop("_i")


def rolling_mean(column: str, width: int, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Mean of the last `width` rows, null until there are so many."""
    over = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1 - width, 0)
    return F.when(F.count(column).over(over) == width, F.avg(column).over(over))


def pct_change(column: str, keys: tuple[str, ...] = ("symbol",), lag: int = 1) -> Column:
    return F.try_divide(F.col(column), F.nullif(F.lag(column, lag).over(Window.partitionBy(*keys).orderBy("seq")), F.lit(0.0))) - 1


def forward_return(column: str, ahead: int = 5, keys: tuple[str, ...] = ("symbol",)) -> Column:
    return F.try_divide(F.lead(column, ahead).over(Window.partitionBy(*keys).orderBy("seq")), F.nullif(F.col(column), F.lit(0.0))) - 1


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "module", value: str = "us") -> DataFrame:
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns))))


def timing_block(long: DataFrame, name: str = "module", value: str = "us") -> DataFrame:
    """mean, median, p50/p95/p99, max, min and population std by module, and each module's share of the means."""
    got = long.groupBy(name).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"))
    got = beside(got, quantiles(long, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, name).drop("n"), name)
    total = F.sum("mean").over(Window.partitionBy(F.lit(0)))  # a row for each module
    return got.select(name, "mean", "p50", "p95", "p99", "max", "min", "std", (F.col("mean") / total * 100).alias("share_pct"))


def load_summary(df: DataFrame, value: str, ok: Column) -> DataFrame:
    """Messages, success rate, mean and the 99th percentile by nearest rank."""
    total = df.agg(F.count("*").alias("messages"), F.avg(ok.cast("double")).alias("success_rate"), F.avg(value).alias("mean"))
    rank = F.least(F.floor(F.col("n") * 0.99).cast("long"), F.col("n") - 1)
    return total.crossJoin(ranked(df, value, {"p99": rank}).drop("n"))  # one row each


#: Values of one rank's range that are sorted in one place.
SORTED = 50_000
#: Rows of ranks that are broadcast at most.
FEW = 50_000
EDGES = 256


def ranked(df: DataFrame, column: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, n, a column for each rank): exact values by their place from 0 in order, null without any; `ranks` are expressions over n.

    Every rank has a range of values that surely holds it, at first all. While a range has more than SORTED rows, a pass takes
    quantiles of them, each estimated from a sketch, as edges, another counts exactly what is below and between the two edges around the
    rank, and the range becomes the part where the rank is, which is smaller as edges are values of it. A sketch that is wrong
    costs a pass, not the result. What is left is sorted by range. So no pass keeps more than a sketch or a count for a rank; rows are in no exchange while ranks are few.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    n = df.groupBy(*keys).agg(F.count(column).alias("n"))
    each = F.array(*(F.struct(F.lit(k).alias("_id"), r.cast("long").alias("_rank")) for k, r in ranks.items()))
    none = F.lit(None).cast(rows.schema["_v"].dataType)
    # rows below the range don't count any more: `_rank` is the place in it
    state = n.select(*keys, "n", F.inline(each)).where("n > 0").withColumns({"_lo": none, "_hi": none, "_in": F.col("n")})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]

    def within(columns: list[str], where: Column) -> DataFrame:
        known = state.where(where).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_id", *columns)
        few = state.count() <= FEW
        inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
        known = F.broadcast(known) if few else known
        return (rows.join(known, on) if keys else rows.crossJoin(known)).where(inside)  # a few ranks each

    large = (F.col("_in") > SORTED) & (F.col("_lo").isNull() | (F.col("_lo") < F.col("_hi")))
    state = _kept(state)
    while state.where(large).limit(1).count():
        probe = within(["_lo", "_hi"], large).groupBy(*keys, "_id").agg(F.percentile_approx("_v", F.array(*(F.lit(i / EDGES) for i in range(EDGES + 1))), 20 * EDGES).alias("_edges"))
        at = F.floor(F.col("_rank") * EDGES / F.col("_in")).cast("int")
        edge = state.join(probe, [*keys, "_id"], "left") if not keys else state.join(probe.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_id").alias("_i"), "_edges"), [*on, F.col("_id") == F.col("_i")], "left")
        state = _kept(edge.select(*keys, "n", "_id", "_rank", "_lo", "_hi", "_in", F.get("_edges", F.greatest(at - 1, F.lit(0))).alias("_a"), F.get("_edges", F.least(at + 2, F.lit(EDGES))).alias("_b")))
        v, low, high = F.col("_v"), F.col("_a"), F.col("_b")
        counted = within(["_lo", "_hi", "_a", "_b"], large).groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_id").alias("_i")).agg(
            F.count_if(v < low).alias("_under"), F.count_if(v == low).alias("_at_a"), F.count_if((v > low) & (v < high)).alias("_mid"), F.count_if((v == high) & (low < high)).alias("_at_b"),
            F.max(F.when(v < low, v)).alias("_last"), F.min(F.when(v > high, v)).alias("_next"), F.min(F.when((v > low) & (v < high), v)).alias("_from"), F.max(F.when((v > low) & (v < high), v)).alias("_to"),
        )
        got = state.join(counted, [*on, F.col("_id") == F.col("_i")], "left")
        # below, at the lower edge, between, at the upper edge, above: what holds the rank has fewer rows or one value
        c = F.col
        upto = [c("_under"), c("_under") + c("_at_a"), c("_under") + c("_at_a") + c("_mid"), c("_under") + c("_at_a") + c("_mid") + c("_at_b")]
        where = [c("_rank") < x for x in upto]

        def pick(old: Column, *parts: Column) -> Column:
            out = F.when(c("_i").isNull(), old)
            for inside, part in zip(where, parts):
                out = out.when(inside, part)
            return out.otherwise(parts[-1])

        state = _kept(
            got.select(
                *keys, "n", "_id", pick(c("_rank"), c("_rank"), *(c("_rank") - x for x in upto)).alias("_rank"), pick(c("_lo"), c("_lo"), low, c("_from"), high, c("_next")).alias("_lo"),
                pick(c("_hi"), c("_last"), low, c("_to"), high, c("_hi")).alias("_hi"), pick(c("_in"), c("_under"), c("_at_a"), c("_mid"), c("_at_b"), c("_in") - upto[3]).alias("_in"),
            )
        )
    single = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi"))
    last = within(["_rank", "_lo", "_hi"], ~F.coalesce(single, F.lit(False))).groupBy(*keys, "_id", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    values = last.select(*keys, "_id", F.get("_all", F.col("_rank").cast("int")).alias("_value")).unionByName(state.where(single).select(*keys, "_id", F.col("_lo").alias("_value")))
    wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col("_id") == k, F.col("_value"))).alias(k) for k in ranks))
    return beside(n, wide, *keys)


def _kept(state: DataFrame) -> DataFrame:
    """A small table cut off from how it came about, where executors can read it again."""
    spark = state.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidebook"
            if named.startswith("file:") and not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named)
    return state.checkpoint()


def quantiles(df: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, n, a column for each share): exact quantiles, interpolated between the two values around."""
    place = {k: (F.col("n") - 1) * F.lit(p) for k, p in shares.items()}
    two = {f"_f_{k}": F.floor(x) for k, x in place.items()} | {f"_c_{k}": F.ceil(x) for k, x in place.items()}
    got = ranked(df.withColumn(column, F.col(column).cast("double")), column, two, *keys)
    low, high = (lambda k: F.col(f"_f_{k}")), (lambda k: F.col(f"_c_{k}"))
    between = lambda k: F.when(low(k) == high(k), low(k)).otherwise(low(k) + (place[k] - F.floor(place[k])) * (high(k) - low(k)))  # noqa: E731  infinite ones too
    return got.select(*keys, "n", *(between(k).alias(k) for k in shares))
