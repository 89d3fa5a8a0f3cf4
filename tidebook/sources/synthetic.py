"""A seeded synthetic market as a Spark data source, in batch and as a stream: format `tidebook_synthetic`.

Each symbol is a partition with its own generator, so rows do not depend on the number of executors. Options: symbols
(comma-separated), ticks (for each symbol), seed, tick_ms, start (ISO time), rate (ticks for each symbol and batch, stream).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidebook.schema import SNAPSHOT

#: Names and first prices of the default symbols, and the price step.
SYMBOLS = {"RELIANCE": 2900.0, "TCS": 4100.0, "INFY": 1800.0, "HDFCBANK": 1650.0, "ICICIBANK": 1250.0}
STEP = 0.05
NAME = "tidebook_synthetic"


def _snap(x: float) -> float:
    return round(round(x / STEP) * STEP, 2)


def snapshots(symbol: str, index: int, symbols: int, ticks: int, seed: int, tick_ms: int, start: datetime) -> Iterator[tuple]:
    """Snapshots of one symbol: a mid that reverts to its anchor, with a decaying imbalance that moves it."""
    rng = random.Random(f"{seed}/{symbol}")
    anchor = SYMBOLS.get(symbol) or rng.uniform(900, 1100)
    mid, bias, volume = anchor, 0.0, 0
    for k in range(ticks):
        if rng.random() < 0.02:
            bias = rng.uniform(-0.6, 0.6)
        bias *= 0.98
        vol = 4e-4 * anchor
        mid = max(1.0, mid + 0.015 * (anchor - mid) + rng.gauss(0, vol) + 2 * bias * vol)
        half = rng.choice((1, 1, 1, 2, 2, 3)) * STEP
        touch = (_snap(mid - half), _snap(mid + half))

        def side(best: float, way: int, lean: float) -> list[tuple]:
            base = rng.randint(80, 400)
            return [(round(best + way * i * STEP, 2), max(1, int(base * 0.9**i * lean * rng.uniform(0.6, 1.4))), rng.randint(1, 8)) for i in range(5)]

        bids, asks = side(touch[0], -1, 1 + bias), side(touch[1], 1, 1 - bias)
        ltq = rng.randint(500, 2000) if rng.random() < 0.01 else rng.randint(1, 50)
        volume += ltq
        up = rng.random() < min(0.9, max(0.1, 0.5 + bias / 2))
        seq = k * symbols + index
        yield seq, symbol, start + timedelta(milliseconds=tick_ms * seq), bids, asks, touch[1] if up else touch[0], ltq, volume


LEVELS = pa.struct([("price", pa.float64()), ("qty", pa.int64()), ("orders", pa.int32())])
KINDS = {"seq": pa.int64(), "symbol": pa.string(), "ts": pa.timestamp("us", "UTC"), "bids": pa.list_(LEVELS), "asks": pa.list_(LEVELS), "ltp": pa.float64(), "ltq": pa.int64(), "volume": pa.int64()}


def batches(rows: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Snapshots as Arrow batches: columns, not a conversion of each nested row."""
    while some := list(islice(rows, size)):
        columns = []
        for values, kind in zip(zip(*some), KINDS.values()):
            if pa.types.is_list(kind):
                flat = zip(*(level for side in values for level in side))
                levels = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, LEVELS)], fields=list(LEVELS))
                ends = np.cumsum([0, *map(len, values)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), levels, type=kind))
            else:
                columns.append(pa.array(values, kind))
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(KINDS.items()))


class Part(InputPartition):
    def __init__(self, index: int, symbol: str):
        super().__init__(index)
        self.index, self.symbol = index, symbol


class _Settings:
    def __init__(self, options: dict):
        self.symbols = [s for s in (x.strip().upper() for x in options.get("symbols", ",".join(SYMBOLS)).split(",")) if s]
        if not self.symbols:
            raise ValueError("at least one symbol is needed")
        self.ticks, self.seed = int(options.get("ticks", 1000)), int(options.get("seed", 42))
        self.tick_ms, self.rate = int(options.get("tick_ms", 200)), int(options.get("rate", 100))
        self.start = datetime.fromisoformat(options.get("start", "2026-01-02T09:15:00+00:00"))
        if self.start.tzinfo is None:
            self.start = self.start.replace(tzinfo=timezone.utc)

    def rows(self, index: int) -> Iterator[tuple]:
        return snapshots(self.symbols[index], index, len(self.symbols), self.ticks, self.seed, self.tick_ms, self.start)


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self):
        return [Part(i, s) for i, s in enumerate(self.settings.symbols)]

    def read(self, partition: Part):
        return batches(self.settings.rows(partition.index))


class _Stream(SimpleDataSourceStreamReader):
    """`rate` ticks of each symbol in a batch, until `ticks` are out; replayable from any offset.

    The generators go on from where the last batch ended; another offset begins them anew.
    """

    def __init__(self, settings: _Settings):
        self.settings, self.at, self.going = settings, None, []

    def initialOffset(self):
        return {"tick": 0}

    def _between(self, a: int, b: int):
        if self.at != a:
            self.going = [self.settings.rows(i) for i in range(len(self.settings.symbols))]
            for rows in self.going:
                next(islice(rows, a, a), None)
        self.at = b
        return iter(sorted((r for rows in self.going for r in islice(rows, b - a)), key=lambda r: r[0]))

    def read(self, start: dict):
        end = min(start["tick"] + self.settings.rate, self.settings.ticks)
        return self._between(start["tick"], end), {"tick": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._between(start["tick"], end["tick"])

    def commit(self, end: dict):
        pass


class SyntheticMarket(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        return _Reader(_Settings(self.options))

    def simpleStreamReader(self, schema):
        return _Stream(_Settings(self.options))


class LiveFeed(DataSource):
    """The place of a live brokerage feed, which needs a vendor's client: it can be named, not read."""

    @classmethod
    def name(cls):
        return "tidebook_live"

    def schema(self):
        return SNAPSHOT

    def reader(self, schema):
        missing = [k for k in ("api_key", "client_code", "password", "totp_secret") if not self.options.get(k)]
        raise NotImplementedError(f"no vendor client is installed; missing credentials: {missing}")


SOURCES = {"mock": SyntheticMarket, "live": LiveFeed}


def register(spark: SparkSession) -> None:
    for source in SOURCES.values():
        spark.dataSource.register(source)


def make_source(spark: SparkSession, kind: str = "mock", stream: bool = False, **options):
    """A DataFrame of snapshots from a source by its configured name."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; known: {sorted(SOURCES)}")
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format(SOURCES[kind].name()).options(**{k: str(v) for k, v in options.items()}).load()
