"""Stateful streams: the live profile, topic queues, rate limit, and what a replayed batch leaves."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidebook.operators import alerts, books, research
from tidebook.operators import estimators as est
from tidebook.schema import SNAPSHOT
from tidebook.sources import store, timings
from tidebook.streaming import live

T0 = datetime(2026, 9, 7, 9, 15, tzinfo=timezone.utc)


def snapshots(n, seed, symbols=("AAA", "BBB"), first=0):
    r = random.Random(seed)
    rows, volume = [], dict.fromkeys(symbols, 0)
    for i in range(first, first + n):
        s = symbols[i % len(symbols)]
        day = i // 120
        volume[s] = 5 if i % 120 < len(symbols) else volume[s] + r.randint(0, 9)
        mid = 100 + 0.25 * r.randint(-8, 8)
        book = lambda sign: [(mid + sign * 0.5 * (k + 1), r.randint(1, 50), 1) for k in range(5)]  # noqa: E731, B023
        rows.append((i, s, T0 + timedelta(days=day, seconds=i), book(-1), book(1), mid, r.randint(1, 9), volume[s]))
    return rows


def files(spark, tmp_path, rows, schema, parts):
    """A streamed folder with a file for each batch."""
    root = str(tmp_path / "in")
    per = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * per : (k + 1) * per], schema).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(spark.createDataFrame(rows[:1], schema).schema).option("maxFilesPerTrigger", 1).parquet(root)


def run(stream, tmp_path, sink, name="cp"):
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_live_profile_is_the_batch_profile(spark, tmp_path):
    rows = snapshots(400, 1)
    out, live_rows = str(tmp_path / "out"), str(tmp_path / "gated")
    run(live.gated(files(spark, tmp_path, rows, SNAPSHOT, 5)), tmp_path, lambda b, e: b.write.mode("append").parquet(live_rows))
    accepted = spark.readStream.schema(spark.read.parquet(live_rows).schema).option("maxFilesPerTrigger", 3).parquet(live_rows)
    q = live.profiles(accepted).writeStream.foreachBatch(lambda b, e: b.withColumn("epoch", F.lit(e)).write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp2")).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.read.parquet(out).orderBy("epoch").collect():
        held = got.setdefault(r["symbol"], (r["island"], {}))
        if r["island"] > held[0]:
            got[r["symbol"]] = held = (r["island"], {})
        if r["bucket"] is not None:
            held[1][r["bucket"]] = r["qty"]
    want = {}
    ticks = books.flatten(spark.createDataFrame(rows, SNAPSHOT))
    for r in est.volume_profile(ticks).collect():
        want.setdefault(r["symbol"], {})[r["bucket"]] = r["qty"]
    assert {s: x for s, (_, x) in got.items()} == want and len(want) == 2


@pytest.mark.parametrize("size", [3, 200])
def test_queues_drop_the_oldest(spark, tmp_path, size):
    """Bursts against plain lists; drops are exact and feed the exposed series."""
    r = random.Random(2)
    rows = []
    for seq in range(300):
        topic, subscriber = r.choice(["book:AAA", "alerts"]), r.choice(["x", "y"])
        rows.append((topic, subscriber, seq, None if (take := r.random() < 0.05) else f"m{seq}", take))
    out = str(tmp_path / "out")
    run(live.queues(files(spark, tmp_path, rows, "topic string, subscriber string, seq long, payload string, take boolean", 6), size), tmp_path, lambda b, e: b.write.mode("append").parquet(out))
    held, taken, drops = {}, [], {}
    for topic, subscriber, seq, payload, take in rows:
        q = held.setdefault((topic, subscriber), [])
        if take:
            taken += [(topic, subscriber, *m) for m in q]
            q.clear()
        else:
            q.append((seq, payload))
            if len(q) > size:
                q.pop(0)
                drops[topic] = drops.get(topic, 0) + 1
    got = spark.read.parquet(out)
    assert sorted(tuple(x)[:4] for x in got.where("seq is not null").collect()) == sorted(taken) and taken
    assert {k: n for k, n in live.dropped_by_topic(got).items() if n} == drops and bool(drops) == (size == 3)
    text = live.exposed(live.series(live.Totals(), dropped=live.dropped_by_topic(got)))
    assert all(f'messages_dropped_total{{topic="{k}"}} {n}' in text for k, n in drops.items())


def test_topics_name_what_goes_out(spark):
    one = spark.createDataFrame([(1, "AAA", 2.5)], "seq long, symbol string, ltp double")
    got = sorted(tuple(r) for r in alerts.topics(one, one, one.drop("ltp")).collect())
    assert got == [("alerts", 1, '{"seq":1,"symbol":"AAA"}'), ("book:AAA", 1, '{"seq":1,"symbol":"AAA","ltp":2.5}'), ("metrics:AAA", 1, '{"seq":1,"symbol":"AAA","ltp":2.5}')]


def test_rate_limit_by_minute(spark, tmp_path):
    r = random.Random(3)
    us = sorted(r.randrange(0, 400_000_000) for _ in range(300))
    rows = [(r.choice("ab"), i, t) for i, t in enumerate(us)]
    out = str(tmp_path / "out")
    stream = live.rate_limited(files(spark, tmp_path, rows, "key string, seq long, us long", 6), cap=10, late="1 minute")
    run(stream, tmp_path, lambda b, e: b.write.mode("append").parquet(out))
    want = {x["seq"]: x["allowed"] for x in alerts.rate_limit(spark.createDataFrame(rows, "key string, seq long, us long"), "key", "us", 10).collect()}
    got = {x["seq"]: x["allowed"] for x in spark.read.parquet(out).collect()}
    assert got == want and not all(want.values())
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "counts").load()
    kept = {x["user_map_key"]["minute"] for x in state.select("user_map_key").collect()} if "user_map_key" in state.columns else {x["key"]["minute"] for x in state.collect()}
    assert kept and min(kept) >= (us[-1] - 120_000_000) // live.MINUTE - 1  # minutes behind the watermark are gone


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    """The sink after the store fails; the batch runs again and each tick is there once. Calls without a number add."""
    rows = snapshots(60, 4)
    root, failed = str(tmp_path / "store"), []

    def then(batch, epoch):
        if epoch == 1 and not failed:
            failed.append(epoch)
            raise OSError("down")

    stream = live.gated(files(spark, tmp_path, rows, SNAPSHOT, 3)).withColumn("ts", F.timestamp_micros("us"))
    sinks = {"store": store.sink(root), "after": then}
    start = lambda: live.fan_out(stream, sinks, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="down"):
        start().processAllAvailable()
    q = start()
    q.processAllAvailable()
    q.stop()
    assert failed == [1]
    back = [x for s in ("AAA", "BBB") for x in store.read_day(spark, root, s, "2026-09-07").collect()]
    assert len(back) == len({(x["symbol"], x["ts"]) for x in back}) == 60
    one = books.flatten(spark.createDataFrame(rows[:4], SNAPSHOT))
    store.append(one, str(tmp_path / "plain"))
    store.append(one, str(tmp_path / "plain"))
    assert store.read_day(spark, str(tmp_path / "plain"), "AAA", "2026-09-07").count() == 4


def test_timings_of_a_real_run(spark, tmp_path):
    stream = live.gated(files(spark, tmp_path, snapshots(60, 8), SNAPSHOT, 3))
    q = stream.writeStream.foreachBatch(lambda b, e: b.write.format("noop").mode("append").save()).queryName("profiled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    table = timings.timings(spark, q)
    q.stop()
    rows = table.collect()
    assert {r["batch"] for r in rows} == {0, 1, 2} and {r["query"] for r in rows} == {"profiled"} and all(r["us"] >= 0 for r in rows)
    assert {"total", "addBatch", "state0.commit"} <= {r["module"] for r in rows}
    block = {r["module"]: r for r in research.timing_block(timings.phases(table)).collect()}
    assert sum(r["share_pct"] for r in block.values()) == pytest.approx(100) and block["addBatch"]["p50"] <= block["addBatch"]["max"]
