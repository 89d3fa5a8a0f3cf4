"""Histories with bounds that are the feature: last alerts, last rows by key, topics with drop-oldest, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, TOPIC = 500, 200


def last_alerts(alerts: DataFrame, n: int, order: tuple[str, ...] = ("seq", "place")) -> DataFrame:
    """The last n alerts (of a history of 500), oldest first; none for n <= 0."""
    n = max(0, min(n, HISTORY))
    return alerts.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def last_by_key(df: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The newest row of each key: a plain aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")


def topics(ticks: DataFrame, metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """(topic, seq, payload): `book:<symbol>`, `metrics:<symbol>` and `alerts`."""
    as_json = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    named = lambda df, topic: df.select(topic.alias("topic"), "seq", as_json(df).alias("payload"))
    return named(ticks, F.concat(F.lit("book:"), "symbol")).unionAll(named(metrics, F.concat(F.lit("metrics:"), "symbol"))).unionAll(named(alerts, F.lit("alerts")))


def drop_oldest(messages: DataFrame, size: int = TOPIC) -> tuple[DataFrame, DataFrame]:
    """(what each topic's queue still holds, drops by topic)."""
    held = last_by_key(messages, size, ("topic",))
    drops = messages.groupBy("topic").agg(F.greatest(F.lit(0), F.count("*") - size).alias("dropped"))
    return held, drops


def rate_limit(calls: DataFrame, key: str, us: str, cap: int = 120, order: str = "seq") -> DataFrame:
    """Adds `allowed`: whether the call is among the first `cap` of its key and minute; a cap of 0 never throttles."""
    minute = F.floor(F.col(us) / 60_000_000)
    by = Window.partitionBy(key, minute).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("allowed", F.lit(True) if cap <= 0 else F.count("*").over(by) <= cap)


def exposition(counters: DataFrame) -> DataFrame:
    """(line): a counter table (name, kind, help, value) as Prometheus text."""
    text = F.array(F.concat_ws(" ", F.lit("# HELP"), "name", "help"), F.concat_ws(" ", F.lit("# TYPE"), "name", "kind"), F.concat_ws(" ", "name", F.col("value").cast("string")))
    return counters.select(F.explode(text).alias("line"))


def session_bucket(ts: Column, minutes: int = 15) -> Column:
    """HHMM of the storage bucket that a time falls in."""
    return F.concat(F.date_format(ts, "HH"), F.lpad((F.floor(F.minute(ts) / minutes) * minutes).cast("string"), 2, "0"))
