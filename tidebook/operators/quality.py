"""The quality gate: repair, stateless codes as expressions, and the sequential checks against what was accepted before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.schema import DEPTH

#: Reason codes in the order in which they are found.
CODES = (
    "invalid_symbol", "empty_symbol", "unknown_symbol", "invalid_timestamp", "invalid_book_depth", "invalid_book_level", "bids_not_descending", "asks_not_ascending",
    "crossed_or_locked_book", "invalid_ltp", "invalid_ltq", "invalid_volume", "non_monotonic_timestamp", "cumulative_volume_decrease",
)


def _bad(x: Column) -> Column:
    """Not a finite number above 0; null counts as bad."""
    return x.isNull() | F.isnan(x) | (x == float("inf")) | ~(x > 0)


def _book(side: str) -> tuple[Column, Column, Column]:
    """Wrong depth, wrong level, wrong order of one side."""
    b = F.col(side)
    depth = b.isNull() | (F.size(b) < 1) | (F.size(b) > DEPTH)
    level = F.coalesce(F.exists(b, lambda x: x.isNull() | _bad(x["price"]) | x["qty"].isNull() | (x["qty"] <= 0) | (F.coalesce(x["orders"], F.lit(0)) < 0)), F.lit(False))
    wrong = lambda i: (F.get(b, i - 1)["price"] <= F.get(b, i)["price"]) if side == "bids" else (F.get(b, i - 1)["price"] >= F.get(b, i)["price"])
    order = F.when(F.size(b) > 1, F.exists(F.sequence(F.lit(1), F.size(b) - 1), wrong)).otherwise(False)
    return depth, level, order


def stateless(snapshots: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Adds original_symbol, repaired_fields and `reasons`; the symbol is trimmed and upper-cased."""
    df = snapshots.withColumn("original_symbol", F.col("symbol")).withColumn("symbol", F.upper(F.trim("symbol")))
    df = df.withColumn("repaired_fields", F.when(F.col("symbol").eqNullSafe(F.col("original_symbol")), F.array().cast("array<string>")).otherwise(F.array(F.lit("symbol"))))
    symbol = F.when(F.col("original_symbol").isNull(), "invalid_symbol").when(F.col("symbol") == "", "empty_symbol")
    if allowed:
        symbol = symbol.when(~F.col("symbol").isin(*allowed), "unknown_symbol")
    sides = [_book("bids"), _book("asks")]
    gone = F.col("bids").isNull() | F.col("asks").isNull()
    level = ~gone & (sides[0][1] | sides[1][1])
    fine = ~gone & ~level
    two = (F.size("bids") > 0) & (F.size("asks") > 0)
    found = F.array(
        symbol,
        F.when(F.col("ts").isNull(), "invalid_timestamp"),
        F.when(sides[0][0] | sides[1][0], "invalid_book_depth"),
        F.when(level, "invalid_book_level"),
        F.when(fine & sides[0][2], "bids_not_descending"),
        F.when(fine & sides[1][2], "asks_not_ascending"),
        F.when(fine & two & (F.get("bids", 0)["price"] >= F.get("asks", 0)["price"]), "crossed_or_locked_book"),
        F.when(F.col("ltp").isNotNull() & _bad(F.col("ltp")), "invalid_ltp"),
        F.when(F.col("ltq") < 0, "invalid_ltq"),
        F.when(F.col("volume") < 0, "invalid_volume"),
    )
    return df.withColumn("reasons", F.array_distinct(F.array_compact(found)))


DAY = 86_400_000_000
#: Runs of the gate that go to one task of Python at least.
RUNS = 4096


def fold(rows: Iterator[tuple], state: tuple | None) -> tuple[list[list[str]], tuple | None]:
    """Codes of (us, volume, good) in order, against the last accepted time and volume; the state moves on acceptance only."""
    last_us, last_volume = state or (None, None)
    out = []
    for us, volume, good in rows:
        codes = []
        if us is not None and last_us is not None:
            if us <= last_us:
                codes.append("non_monotonic_timestamp")
            same_day = us // DAY == last_us // DAY
            if same_day and volume is not None and last_volume is not None and volume < last_volume:
                codes.append("cumulative_volume_decrease")
        out.append(codes)
        if good and not codes:
            last_us, last_volume = us, volume if volume is not None else last_volume
    return out, (last_us, last_volume)


def runs(keys: DataFrame) -> DataFrame:
    """Adds to (seq, _sym, us, volume, good) the state before each row, the run it belongs to and whether the run is doubtful.

    A good row later than all good rows before, whose volume isn't below any that could count, is accepted whatever
    happened to those: it is sure. A row that is not later than the last sure one is rejected whatever happened since. A sure
    row with a volume, or before which no volume was known, settles the whole state and begins a run. Rows that aren't
    good or are rejected in any case change nothing. So in a run without other rows the state is known: the last sure row's.
    """
    by = Window.partitionBy("_sym").orderBy("seq")
    before, day = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_sym", "_day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("good")
    df = keys.withColumn("_day", F.floor(F.col("us") / DAY)).withColumns({"_gus": F.when(good, F.col("us")), "_gvol": F.when(good, F.col("volume"))})
    df = df.withColumns({"_top": F.max("_gus").over(before), "_most": F.max("_gvol").over(before)})
    df = df.withColumns({"_high": F.max("_gvol").over(day), "_bare": F.max(F.when(good & F.col("volume").isNull(), 1)).over(day)})
    least = F.when(F.col("_bare").isNotNull(), F.col("_most")).otherwise(F.col("_high"))  # a day without volume so far goes on from the days before
    later = F.coalesce(F.col("us") > F.col("_top"), F.lit(True))
    df = df.withColumn("_sure", good & F.col("us").isNotNull() & later & (F.col("volume").isNull() | F.coalesce(F.col("volume") >= least, F.lit(True))))
    df = df.withColumns(
        {
            "last_us": F.last(F.when(F.col("_sure"), F.col("us")), True).over(before),
            "last_volume": F.last(F.when(F.col("_sure"), F.col("volume")), True).over(before),
            "run": F.count(F.when(F.col("_sure") & (F.col("volume").isNotNull() | F.col("_most").isNull()), 1)).over(by.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    lost = F.coalesce(F.col("us") <= F.col("last_us"), F.lit(False))
    doubt = F.max(good & ~F.col("_sure") & ~lost).over(Window.partitionBy("_sym", "run"))
    return df.select("seq", "_sym", "us", "volume", "good", "_day", "last_us", "last_volume", "run", doubt.alias("doubtful"))


def gate(snapshots: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """stateless() with the sequential codes added, from each symbol's rows in order of arrival.

    Acceptance depends on earlier acceptance, which windows can't express, but only from a row that might be rejected on
    to the next that is surely accepted. Such runs alone go through Python, in order and batch by batch (a run's first row
    is accepted whatever came before), so that no run, however long, is held as a whole; books stay in the JVM, and what is
    rejected late is joined back by seq.
    """
    df = stateless(snapshots, allowed)
    keys = df.select("seq", F.coalesce("symbol", F.lit("")).alias("_sym"), F.unix_micros("ts").alias("us"), "volume", (F.size("reasons") == 0).alias("good"))
    known = runs(keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = None, None
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("seq", "_sym", "us", "volume", "good", "run")}
            late = []
            edges = [i for i in range(1, b.num_rows) if (c["_sym"][i], c["run"][i]) != (c["_sym"][i - 1], c["run"][i - 1])]
            for i, j in zip([0, *edges], [*edges, b.num_rows]):
                if run != (c["_sym"][i], c["run"][i]):
                    run, state = (c["_sym"][i], c["run"][i]), None
                codes, state = fold(zip(c["us"][i:j], c["volume"][i:j], c["good"][i:j]), state)
                late += codes
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(late, pa.list_(pa.string()))], names=["seq", "_late"])

    back = F.col("us") <= F.col("last_us")
    fall = (F.col("_day") == F.floor(F.col("last_us") / DAY)) & (F.col("volume") < F.col("last_volume"))
    codes = F.array_compact(F.array(F.when(back, "non_monotonic_timestamp"), F.when(fall, "cumulative_volume_decrease")))
    settled = known.where(~F.col("doubtful") & (~F.col("good") | back) & (back | fall)).select("seq", codes.alias("_late"))
    doubtful = known.where("doubtful").select("seq", "_sym", "us", "volume", "good", "run")
    walked = doubtful.repartition("_sym", F.floor(F.col("run") / RUNS)).sortWithinPartitions("_sym", "run", "seq").mapInArrow(walk, "seq long, _late array<string>")
    late = settled.unionAll(walked.where(F.size("_late") > 0))
    both = df.join(late, "seq", "left")
    out = both.withColumn("reasons", F.concat("reasons", F.coalesce("_late", F.array().cast("array<string>")))).drop("_late")
    return out.withColumn("accepted", F.size("reasons") == 0)


def accepted(gated: DataFrame) -> DataFrame:
    return gated.where("accepted").drop("reasons", "accepted", "original_symbol", "repaired_fields")


def quarantine(gated: DataFrame) -> DataFrame:
    """Rejected rows as the quarantine keeps them: five keys, the snapshot nested."""
    return gated.where("not accepted").select(
        F.current_timestamp().alias("quarantined_at"), F.col("reasons").alias("rejection_reasons"), "repaired_fields", "original_symbol", F.struct("seq", "symbol", "ts", "bids", "asks", "ltp", "ltq", "volume").alias("snapshot")
    )


def reason_counts(gated: DataFrame) -> DataFrame:
    """(reason, n), most frequent first."""
    return gated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def counters(gated: DataFrame) -> DataFrame:
    """received, accepted, rejected, repaired (accepted rows only)."""
    return gated.agg(F.count("*").alias("received"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("accepted") & (F.size("repaired_fields") > 0)).alias("repaired"))
