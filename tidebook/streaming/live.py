"""Live ticks: one stateful operator by symbol that carries the gate and all estimators, and plain plans on each micro-batch.

State lives in variables of `transformWithState`: what a batch doesn't change is not written. The estimators are those of the batch
(functions.rolling), run over a batch's accepted rows from the state that the last one left. Late or repeated times are
rejected, not waited for, so there is no watermark but for the rate limit's timers.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tidebook.functions import rolling
from tidebook.operators import books, quality
from tidebook.operators import estimators as batch
from tidebook.operators.alerts import TOPIC

SPANS = (60, 300, 900)
TOP = ("bid_px_1", "bid_qty_1", "ask_px_1", "ask_qty_1")
PASSED = ("midprice", "spread", "relative_spread", "weighted_spread")
FIELDS = (
    "ofi", "ofi_60s", "ofi_300s", "ofi_900s", "vwap", "vwap_dev", "vwap_stdev", "cum_delta", "kyle_lambda", "kyle_r2", "kyle_t_stat", "amihud_illiq",
    "roll_spread_bps", "roll_serial_cov", "trade_variance_share", "avg_signed_trade_return_bps", "z_spread", "z_volume", "z_ofi",
)
#: What alerts and the volume profile need besides.
MORE = ("tick_volume", "island", "dvol")
WHOLE = ("cum_delta", "tick_volume", "island", "dvol")
ALERT = "array<struct<kind:string,severity:string,detail:map<string,double>>>"
GATE_OUT = ", ".join(
    ["seq long, symbol string, us long, bid_px_1 double, bid_qty_1 long, ask_px_1 double, ask_qty_1 long, ltp double, ltq long, volume long"]
    + [f"{c} double" for c in PASSED]
    + ["reasons array<string>, repaired boolean, accepted boolean"]
    + [f"{c} {'long' if c in WHOLE else 'double'}" for c in (*FIELDS, *MORE)]
    + [f"alerts {ALERT}"]
)
MINUTE = 60_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """State of several variables and timers needs this store of states; it writes what has changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def estimators() -> dict[str, object]:
    """What metrics and alerts take; the order-flow event comes with its score."""
    some = batch.metrics_estimators()
    del some["flow"]
    return some | batch.score_estimators()


def raised(f: dict, threshold: float = 3.0) -> list[dict]:
    """Alerts of a tick's fields in order spread, volume, flow."""
    rows = (("spread_blowup", "z_spread", {"spread": f["spread"]}), ("volume_spike", "z_volume", {"tick_volume": f["tick_volume"]}), ("ofi_extreme", "z_ofi", {"ofi": round(f["ofi"], 2)}))
    out = []
    for kind, name, detail in rows:
        z = f[name]
        if (abs(z) if name == "z_ofi" else z) > threshold:  # nan is not
            severity = "warn" if abs(z) < 1.5 * threshold else "critical"
            out.append({"kind": kind, "severity": severity, "detail": {k: float(v) for k, v in detail.items()} | {"zscore": round(z, 2)}})
    return out


class Ticks(StatefulProcessor):
    """A symbol's gate and estimators. State: last accepted time and volume; a variable for each estimator, a few numbers and its
    window's last rows, as functions.rolling has them; order-flow events of the longest span by minute, of which a batch
    writes its own minutes and deletes those that have left the span."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.estimators = estimators()
        self.gate = handle.getValueState("gate", "us long, volume long")
        self.parts = {k: handle.getValueState(f"s_{k}", "x array<double>") for k in self.estimators}
        self.minutes = handle.getMapState("minutes", "minute long", "us array<long>, e array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable").reset_index(drop=True)
        whole = lambda c: [None if pd.isna(x) else int(x) for x in pdf[c]]
        us, volume = whole("us"), whole("volume")
        early = [list(x) for x in pdf["reasons"]]
        last = self.gate.get() if self.gate.exists() else (None, None)
        late, last = quality.fold(zip(us, volume, [not x for x in early]), tuple(last))
        reasons = [x + y for x, y in zip(early, late)]
        pdf["reasons"], pdf["accepted"], pdf["repaired"] = reasons, [not x for x in reasons], pdf["repaired"].astype(bool)
        ok = np.flatnonzero(pdf["accepted"].to_numpy())
        fields = {c: np.full(len(pdf), np.nan) for c in (*FIELDS, *MORE)}
        pdf["alerts"] = [[] for _ in range(len(pdf))]
        if len(ok):
            self.gate.update(last)
            good = pdf.iloc[ok]
            times = np.array([us[i] for i in ok], np.int64)
            r = {batch.NAMES.get(c, c): good[c].to_numpy(np.float64, na_value=np.nan) for c in (*TOP, "ltp", "ltq", "volume", "midprice", "spread")} | {"day": (times // quality.DAY).astype(float)}
            for k, e in self.estimators.items():
                state = self.parts[k]
                old = np.array(state.get()[0], float) if state.exists() else rolling.NONE
                for f, v in zip(e.fields, e.run(old, r)):
                    fields[f][ok] = v
                new = e.join(old, e.part(r))
                if not np.array_equal(new, old, equal_nan=True):
                    state.update((new.tolist(),))
            for w, v in zip(SPANS, self.flows(times, fields["ofi"][ok])):
                fields[f"ofi_{w}s"][ok] = v
            shown = fields | {"spread": pdf["spread"].to_numpy(np.float64, na_value=np.nan)}
            over = ok[(fields["z_spread"][ok] > 3) | (fields["z_volume"][ok] > 3) | (np.abs(fields["z_ofi"][ok]) > 3)]
            for i in over:
                pdf.at[i, "alerts"] = raised({k: float(v[i]) for k, v in shown.items()})
        for c, v in fields.items():
            pdf[c] = pd.Series(v).astype("Int64") if c in WHOLE else v
        yield pdf[[c.split()[0] for c in GATE_OUT.replace(ALERT, "alerts").split(", ")]].astype({c: "Int64" for c in ("us", "bid_qty_1", "ask_qty_1", "ltq", "volume")})

    def flows(self, us: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """Sums of events over each span up to each of the accepted times, which rise; events are whole numbers, so sums are exact."""
        held = dict(sorted((k[0], v) for k, v in self.minutes.iterator()))
        old_us, old_e = (np.array([x for v in held.values() for x in v[i]], kind) for i, kind in ((0, np.int64), (1, float)))
        all_us, sums = np.concatenate([old_us, us]), np.concatenate([[0.0], np.cumsum(np.concatenate([old_e, e]))])
        at = np.arange(len(old_us), len(all_us)) + 1
        out = [sums[at] - sums[np.searchsorted(all_us, us - w * 1_000_000)] for w in SPANS]
        minute = us // MINUTE
        for m in np.unique(minute):
            mine = (minute == m) & (e != 0)
            if mine.any():
                before = held.get(int(m), ([], []))
                self.minutes.updateValue((int(m),), ([*before[0], *us[mine].tolist()], [*before[1], *e[mine].tolist()]))
        oldest = (int(us[-1]) - SPANS[-1] * 1_000_000) // MINUTE
        for m in {*held, *map(int, np.unique(minute))}:
            if m < oldest and self.minutes.containsKey((m,)):
                self.minutes.removeKey((m,))
        return out


def gated(snapshots: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """A stream of snapshots with codes, acceptance, and of accepted ticks all estimators and alerts.

    A batch's rows of one symbol are sorted in one place: bound batches at the source (`maxFilesPerTrigger` or its like), above all
    for a first one over a backlog.
    """
    use_rocksdb(snapshots.sparkSession)
    df = books.spreads(books.flatten(quality.stateless(snapshots, allowed)))
    rows = df.select("seq", F.coalesce("symbol", F.lit("")).alias("symbol"), F.unix_micros("ts").alias("us"), *TOP, "ltp", "ltq", "volume", *PASSED, "reasons", (F.size("repaired_fields") > 0).alias("repaired"))
    return rows.groupBy("symbol").transformWithStateInPandas(Ticks(), GATE_OUT, "Append", "None")


class Profile(StatefulProcessor):
    """Volume by price of a symbol's current session: a map that a new session clears. Gives the buckets that a batch has changed."""

    def __init__(self, bucket: float = 0.5):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.island = handle.getValueState("island", "n long")
        self.volume = handle.getMapState("volume", "bucket double", "qty long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        now = self.island.get()[0] if self.island.exists() else -1
        newest = int(pdf["island"].max())
        if newest > now:
            self.volume.clear()
            self.island.update((newest,))
        pdf = pdf[(pdf["island"] == max(newest, now)) & (pdf["dvol"] > 0)]
        place = (np.floor(pdf["ltp"].astype(float) / self.bucket) * self.bucket).round(4)
        out = []
        for b, qty in pdf["dvol"].astype("int64").groupby(place).sum().items():
            total = int(qty) + (self.volume.getValue((b,))[0] if self.volume.containsKey((b,)) else 0)
            self.volume.updateValue((b,), (total,))
            out.append((key[0], max(newest, now), b, total))
        if newest > now and not out:
            out.append((key[0], newest, None, None))
        yield pd.DataFrame(out, columns=["symbol", "island", "bucket", "qty"]).astype({"qty": "Int64", "bucket": "float64"})


def profiles(gated_rows: DataFrame, bucket: float = 0.5) -> DataFrame:
    """(symbol, island, bucket, qty): changed buckets of the profile; the highest island's newest rows are the profile. A null bucket: a new session without trades."""
    rows = gated_rows.where("accepted").select("symbol", "island", "ltp", "dvol")
    return rows.groupBy("symbol").transformWithStateInPandas(Profile(bucket), "symbol string, island long, bucket double, qty long", "Update", "None")


class Queue(StatefulProcessor):
    """Messages that a subscriber has not taken yet, the newest `size` of them in numbered slots; taking them empties the queue."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "first long, next long")
        self.slots = handle.getMapState("slots", "slot long", "seq long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["seq", "take"], kind="stable")
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        held, out, dropped = None, [], 0
        new: dict[int, tuple] = {}
        began = first, following
        for seq, take, payload in zip(pdf["seq"].tolist(), pdf["take"].tolist(), pdf["payload"].tolist()):
            if not take:
                new[following] = (seq, payload)
                following += 1
                if following - first > self.size:
                    new.pop(first, None)
                    first, dropped = first + 1, dropped + 1
                continue
            if held is None:
                held = {k[0]: v for k, v in self.slots.iterator()}
            out += [(*key, *(new.get(k) or held[k]), 0) for k in range(first, following)]
            new, first = {}, following
        for k in range(began[0], min(first, began[1])):
            self.slots.removeKey((k,))
        for k, v in new.items():
            self.slots.updateValue((k,), v)
        self.ends.update((first, following))
        if dropped:
            out.append((*key, None, None, dropped))
        yield pd.DataFrame(out, columns=["topic", "subscriber", "seq", "payload", "dropped"]).astype({"seq": "Int64", "dropped": "int64"})


def queues(messages: DataFrame, size: int = TOPIC) -> DataFrame:
    """(topic, subscriber, seq, payload, dropped) from a stream of (topic, subscriber, seq, payload, take boolean).

    A row with `take` hands out what the subscriber's queue of the topic holds, oldest first; other rows are messages for it (see
    alerts.topics), of which the oldest goes when there are more than `size`. A row with null seq says how many a batch has dropped.
    """
    use_rocksdb(messages.sparkSession)
    return messages.groupBy("topic", "subscriber").transformWithStateInPandas(Queue(size), "topic string, subscriber string, seq long, payload string, dropped long", "Append", "None")


def dropped_by_topic(rows: DataFrame) -> dict[str, int]:
    """Drops of queues(), as series() takes them."""
    return {r["topic"]: r["n"] for r in rows.groupBy("topic").agg(F.sum("dropped").alias("n")).collect()}


class Calls(StatefulProcessor):
    """Calls of a key by minute, forgotten by a timer when the minute is over."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        minute = pdf["us"].astype("int64") // MINUTE
        place = pdf.groupby(minute).cumcount() + 1
        before = {}
        for m, n in minute.value_counts().items():
            before[m] = self.counts.getValue((int(m),))[0] if self.counts.containsKey((int(m),)) else 0
            self.counts.updateValue((int(m),), (before[m] + int(n),))
            self.handle.registerTimer((int(m) + 1) * (MINUTE // 1000))
        pdf["allowed"] = (place + minute.map(before) <= self.cap) if self.cap > 0 else True
        yield pdf[["key", "seq", "us", "allowed"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // MINUTE - 1,))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool)})


def rate_limited(calls: DataFrame, cap: int = 120, late: str = "0 seconds") -> DataFrame:
    """(key, seq, us, allowed) of a stream (key, seq, us): whether a call is among the first `cap` of its key and minute; 0 never throttles.

    A minute's count goes once the watermark, `late` behind the newest call, has left the minute; later calls than that are dropped.
    """
    use_rocksdb(calls.sparkSession)
    rows = calls.select("key", "seq", "us", F.timestamp_micros("us").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Calls(cap), "key string, seq long, us long, allowed boolean", "Append", "EventTime")


def alerts_of(gated_rows: DataFrame) -> DataFrame:
    """(symbol, seq, us, kind, severity, detail) of gated rows."""
    return gated_rows.select("symbol", "seq", "us", F.inline("alerts"))


def observed(gated_rows: DataFrame, name: str = "ticks") -> DataFrame:
    """gated rows that report their counters with each batch, without another pass (see Totals)."""
    accepted = F.coalesce(F.col("accepted"), F.lit(False))
    codes = [F.count_if(F.array_contains("reasons", c)).alias(f"reason_{c}") for c in quality.CODES]
    return gated_rows.observe(
        name, F.count(F.lit(1)).alias("received"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"), F.count_if(accepted & F.col("repaired")).alias("repaired"),
        F.coalesce(F.sum(F.size("alerts")), F.lit(0)).alias("alerts"), F.max(F.when(accepted, F.col("us"))).alias("last_us"), *codes,
    )


class Totals(StreamingQueryListener):
    """Adds up what observed() reports over a process's life, and counts queries that ended with an error."""

    def __init__(self, name: str = "ticks"):
        self.name, self.counts, self.last_us, self.failures = name, {}, None, 0

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        got = row.asDict()
        last = got.pop("last_us", None)
        self.last_us = max(x for x in (self.last_us, last) if x is not None) if (self.last_us, last) != (None, None) else None
        for k, v in got.items():
            self.counts[k] = self.counts.get(k, 0) + int(v or 0)

    def onQueryTerminated(self, event):
        self.failures += event.exception is not None


def series(totals: Totals, sinks: Counter | None = None, clients: dict[str, int] | None = None, dropped: dict[str, int] | None = None, restarts: int = 0, now_us: int | None = None) -> list[tuple]:
    """(name, kind, help, label, value) of every exposed series; sinks: failures by sink (see fan_out)."""
    c, failed = totals.counts, sinks or {}
    now = now_us if now_us is not None else time.time_ns() // 1000
    lag = (now - totals.last_us) / 1e6 if totals.last_us is not None else -1.0
    rows = [
        ("ticks_ingested_total", "counter", "Ticks that the gate accepted.", "", c.get("accepted", 0)),
        ("ticks_persist_failed_total", "counter", "Batches that the store failed to take.", "", failed.get("store", 0)),
        ("source_restarts_total", "counter", "Restarts of the source after an error.", "", restarts),
        ("anomalies_emitted_total", "counter", "Alerts raised.", "", c.get("alerts", 0)),
        ("ticks_rejected_total", "counter", "Ticks that the gate rejected.", "", c.get("rejected", 0)),
        ("ticks_repaired_total", "counter", "Ticks accepted after repair.", "", c.get("repaired", 0)),
        ("quarantine_write_failures_total", "counter", "Batches that the quarantine failed to take.", "", failed.get("quarantine", 0)),
        ("last_tick_lag_seconds", "gauge", "Seconds since the newest accepted tick (-1: none yet).", "", round(lag, 3)),
    ]
    rows += [("ws_clients", "gauge", "Subscribers by topic.", f'topic="{k}"', n) for k, n in sorted((clients or {}).items())]
    rows += [("messages_dropped_total", "counter", "Messages dropped from full queues by topic.", f'topic="{k}"', n) for k, n in sorted((dropped or {}).items())]
    return rows + [("ticks_rejected_reason_total", "counter", "Rejected ticks by reason.", f'reason="{k[7:]}"', n) for k, n in sorted(c.items()) if k.startswith("reason_") and n]


def exposed(rows: list[tuple]) -> str:
    """The text form of series: help and type once for each name."""
    lines, seen = [], set()
    for name, kind, text, label, value in rows:
        if name not in seen:
            seen.add(name)
            lines += [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]
        lines.append(f"{name}{{{label}}} {value}" if label else f"{name} {value}")
    return "\n".join(lines) + "\n"


def fan_out(
    stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, accepted_only: tuple[str, ...] = ("store", "cache", "metrics"), name: str | None = None,
    failures: Counter | None = None, may_fail: tuple[str, ...] = (),
):
    """One query whose batches go to every sink: accepted rows to those named, rejected ones to `quarantine`, all to others.

    Sinks of `may_fail` don't end the query: what they raise is counted in `failures` by sink.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for k, sink in sinks.items():
                try:
                    sink(batch.where("accepted") if k in accepted_only else batch.where("not accepted") if k == "quarantine" else batch, epoch)
                except Exception:
                    if failures is not None:
                        failures[k] += 1
                    if k not in may_fail:
                        raise
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.queryName(name) if name else writer).start()


def upsert_latest(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each symbol as one small table, written beside the old one and then named current."""

    def sink(batch: DataFrame, epoch: int) -> None:
        from tidebook.operators.alerts import latest

        fs = spark._jvm.org.apache.hadoop.fs
        root = fs.Path(path)
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = batch
        old = [e for e in range(epoch - 1, max(-1, epoch - 3), -1) if store.exists(fs.Path(f"{path}/epoch={e}/_SUCCESS"))]
        if old:
            new = spark.read.schema(batch.schema).parquet(f"{path}/epoch={old[0]}").unionByName(batch)
        latest(new).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        store.delete(fs.Path(f"{path}/epoch={epoch - 2}"), True)

    return sink


def backoff(failures: int, least: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait before the restart after so many failures in a row."""
    return min(most, least * 2 ** max(0, failures - 1))


def supervise(start: Callable[[], object], restarts: int = 10, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run a query (start() returns it) until it ends cleanly, restarting it from its checkpoint after failures; the number of restarts."""
    failures = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except Exception:
            failures += 1
            if failures > restarts:
                raise
            sleep(backoff(failures))


def health(query, now_us: int | None = None, fresh_s: float = 30.0) -> dict:
    """Whether the query runs and its last batch with rows is recent; one that has had no rows yet counts as fresh."""
    rows = [p for p in query.recentProgress if p["numInputRows"] > 0]
    last = pd.Timestamp(rows[-1]["timestamp"]).value // 1000 if rows else None
    now = now_us if now_us is not None else time.time_ns() // 1000
    fresh = last is None or now - last < fresh_s * 1e6
    return {"alive": query.isActive, "fresh": fresh, "healthy": query.isActive and fresh}
