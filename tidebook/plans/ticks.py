"""Ticks derived from the `events` table: five symbols, five levels, whole 0.05 ticks, volume restarting daily.

The same SQL, but for dialect, in Spark and DuckDB; prices are whole ticks until one last division, so both give the
same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(raw: str, hundred: str) -> str:
    levels = ", ".join(
        f"(5 * (mid_t - hb - {i})) / {hundred} bid_px_{i + 1}, 80 + k + {10 * i} bid_qty_{i + 1}, (5 * (mid_t + ha + {i})) / {hundred} ask_px_{i + 1}, 80 + user_id % 100 + {10 * i} ask_qty_{i + 1}" for i in range(5)
    )
    return f"""select seq, ts, us, symbol, (5 * (case when k % 2 = 0 then mid_t + ha else mid_t - hb end)) / {hundred} ltp, ltq,
  cast(sum(ltq) over (partition by symbol, cast(ts as date) order by seq rows between unbounded preceding and current row) as bigint) volume, {levels}
  from (select *, 1 + k % 3 hb, 1 + user_id % 3 ha from ({raw}) r) b"""


SPARK = _sql(
    """select event_id seq, cast(ts as timestamp) ts, unix_micros(cast(ts as timestamp)) us, upper(event_type) symbol, user_id,
  cast(get_json_object(props, '$.k') as bigint) k, 2000 + cast(floor(value * 100 + 0.5) as bigint) div 50 mid_t, 1 + user_id % 50 ltq from {events}""",
    "100D",
)
#: Prefix of every DuckDB query: `ticks`.
DUCKDB = "with recursive ticks as (" + _sql(
    """select event_id seq, ts, epoch_us(ts) us, upper(event_type) symbol, user_id,
  cast(json_extract_string(props, '$.k') as bigint) k, 2000 + cast(floor(value * 100 + 0.5) as bigint) // 50 mid_t, 1 + user_id % 50 ltq from events""",
    "100.0::double",
) + ")"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(SPARK, events=events)
