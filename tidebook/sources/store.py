"""Tick store, CSV and JSON files, quarantine and vendor messages."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators.alerts import session_bucket
from tidebook.schema import CSV_TICK, LATENCY, TICK


def placed(ticks: DataFrame, minutes: int = 15) -> DataFrame:
    """Adds the partition columns day and bucket."""
    return ticks.withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "bucket": session_bucket(F.col("ts"), minutes)})


def append(ticks: DataFrame, root: str, minutes: int = 15, epoch: int | None = None) -> None:
    """Append ticks to the Parquet store <root>/symbol=/day=/bucket=/epoch=, rows of a bucket together.

    What a stream's batch writes is named by its number (`epoch`): a batch that is run again after a failure replaces what it wrote
    before instead of adding to it. Without one, each call adds.
    """
    df = placed(ticks, minutes).withColumn("epoch", F.lit(f"b{epoch}" if epoch is not None else f"a{uuid.uuid4().hex}"))
    parts = ["symbol", "day", "bucket", "epoch"]
    df = df.repartition(*parts[:3]).sortWithinPartitions(*parts[:3], *(["seq"] if "seq" in df.columns else []), "ts")
    df.write.partitionBy(*parts).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def sink(root: str, minutes: int = 15):
    """A sink for streaming.live.fan_out that keeps each tick once, however often a batch is run."""
    return lambda batch, epoch: append(batch, root, minutes, epoch)


def read_day(spark: SparkSession, root: str, symbol: str, day: str | date) -> DataFrame:
    """Ticks of a symbol's day in order; partitions are pruned. Empty, with the store's columns, if there are none."""
    fields = [T.StructField("seq", T.LongType()), *TICK.fields, T.StructField("day", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("epoch", T.StringType())]
    try:
        df = spark.read.schema(T.StructType(fields)).option("basePath", root).parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TICK)
    return df.where((F.col("symbol") == symbol) & (F.col("day") == str(day))).orderBy("seq", "ts").select(*TICK.fieldNames())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of a CSV file with an ISO-8601 `timestamp`, as the flat form."""
    return spark.read.schema(CSV_TICK).csv(path, header=True).withColumn("ts", F.to_timestamp("timestamp")).select(*TICK.fieldNames())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LATENCY).csv(path, header=True)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_day_of(ticks: DataFrame, symbol: str, day: str) -> DataFrame:
    """The same selection on a table of ticks."""
    return ticks.where((F.col("symbol") == symbol) & (F.date_format("ts", "yyyy-MM-dd") == day))


VENDOR = "struct<exchange_timestamp:bigint,last_traded_price:bigint,last_traded_quantity:bigint,volume_trade_for_the_day:bigint,best_5_buy_data:array<struct<price:bigint,quantity:bigint,no_of_orders:int>>,best_5_sell_data:array<struct<price:bigint,quantity:bigint,no_of_orders:int>>>"


def normalise(messages: DataFrame, symbol: str, column: str = "raw") -> DataFrame:
    """Vendor messages (JSON, prices in paise, times in ms) as snapshots of five levels: further ones are cut off, orders that a
    level doesn't name are 0, a side that is missing is empty, a last price of 0 is unknown."""
    m = messages.withColumn("_m", F.from_json(column, VENDOR))
    level = lambda x: F.struct((x["price"] / 100).alias("price"), x["quantity"].alias("qty"), F.coalesce(x["no_of_orders"], F.lit(0)).alias("orders"))
    side = lambda c: F.coalesce(F.transform(F.slice(F.col(f"_m.{c}"), 1, 5), level), F.array().cast("array<struct<price:double,qty:bigint,orders:int>>"))
    return m.select(
        "seq", F.lit(symbol).alias("symbol"), F.timestamp_millis("_m.exchange_timestamp").alias("ts"), side("best_5_buy_data").alias("bids"), side("best_5_sell_data").alias("asks"),
        F.when(F.col("_m.last_traded_price") != 0, F.col("_m.last_traded_price") / 100).alias("ltp"), F.col("_m.last_traded_quantity").alias("ltq"), F.col("_m.volume_trade_for_the_day").alias("volume"),
    )
