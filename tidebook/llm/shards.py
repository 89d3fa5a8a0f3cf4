"""Texts dealt into shards of bounded size, as compressed blobs, and sorted fingerprints exchanged between shards and buckets.

A shard is chosen by a hash of the document's id, so every pass over the same documents sees the same shards and,
after sorting, the same order in them. Passes exchange small packed arrays instead of a row for each fingerprint:
shards send (bucket, shard, blob), buckets answer (shard, bucket, blob). A fingerprint is sent at most once by a
shard, so what a bucket gets of one fingerprint is bounded by the number of shards, however hot it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import shared

U = np.uint64
BLOB = "to int, sender int, blob binary"
NO_ID = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), a.size)], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for code, size in zip(head[::2], head[1::2]):
        kind = np.dtype(chr(code))
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def dealt(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, blob): the ids and whole texts, in blobs of what an input batch has of a shard."""
    parts = min(shards, 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    rows = docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int").alias("shard"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            to = b.column(0).to_numpy()
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True]) if to.size else np.zeros(1, int)
            got = b.take(pa.array(order))
            blobs = []
            for i, j in zip(cut[:-1], cut[1:]):
                part = got.slice(i, j - i)
                ids, texts = part.column(1), part.column(2).cast(pa.large_binary()).fill_null(b"")
                off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = texts.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
                blobs.append(pack(ids.fill_null(NO_ID).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), np.diff(off), raw))
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return rows.mapInArrow(run, "shard int, blob binary").repartition(parts, "shard")


class Shard:
    """A shard's documents by id, then text; `ids` holds NO_ID for null, `buf[off[i]:off[i + 1]]` is the i-th text."""

    def __init__(self, table: pa.Table):
        parts = [unpack(x) for x in table.column("blob").to_pylist()] or [[np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint8)]]
        ids, null, size, raw = (np.concatenate([p[i] for p in parts]) for i in range(4))
        off = np.r_[0, np.cumsum(size)].astype(np.int64)
        order = np.argsort(ids, kind="stable")
        same = np.flatnonzero(np.diff(ids[order]) == 0)
        if same.size:  # repeated ids: by text, so that the order doesn't depend on how blobs arrived
            text = [raw[off[i] : off[i + 1]].tobytes() for i in order]
            order = order[sorted(range(order.size), key=lambda i: (ids[order[i]], text[i]))]
        self.ids, self.null = ids[order], null[order].astype(bool)
        self.off = np.r_[0, np.cumsum(size[order])].astype(np.int64)
        take = np.arange(raw.size) - np.repeat(self.off[:-1], size[order]) + np.repeat(off[:-1][order], size[order])
        self.buf = raw[take]

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


def to_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each slice of ascending 64-bit keys begins that goes to bucket 0, 1, ...: buckets are equal ranges of keys."""
    edges = np.arange(buckets, dtype=np.uint64) * U((1 << 64) // buckets if buckets > 1 else 0)
    return np.r_[np.searchsorted(keys, edges), keys.size]


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers by significance, which compress where the high ones are alike."""
    return np.ascontiguousarray(values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T).ravel()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).ravel().view(np.uint64)


def send(sender: int, keys: np.ndarray, buckets: int, *more: np.ndarray) -> pa.Table:
    """Rows (to, sender, blob) of ascending keys and arrays that go with them; none to buckets that get no keys.

    Keys go as differences; 64-bit arrays as byte planes, others as they are.
    """
    cut = to_buckets(keys, buckets)
    to = np.flatnonzero(np.diff(cut))
    blobs = []
    for k in to:
        part = keys[cut[k] : cut[k + 1]]
        rest = [a[cut[k] : cut[k + 1]] for a in more]
        blobs.append(pack(planes(np.diff(part, prepend=U(0))), *(planes(a.view(np.uint64)) if a.dtype.itemsize == 8 else a for a in rest)))
    return pa.table({"to": pa.array(to, pa.int32()), "sender": pa.array(np.full(to.size, sender), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def received(table: pa.Table, wide: tuple[int, ...] = ()) -> tuple[list[int], list[list[np.ndarray]]]:
    """Senders in ascending order and what each has sent; wide: which of the further arrays are of 64 bits."""
    senders = table.column("sender").to_pylist()
    order = sorted(range(len(senders)), key=senders.__getitem__)
    blobs = table.column("blob").to_pylist()
    out = []
    for i in order:
        first, *rest = unpack(blobs[i])
        out.append([np.cumsum(from_planes(first), dtype=np.uint64), *(from_planes(a) if k in wide else a for k, a in enumerate(rest))])
    return [senders[i] for i in order], out


def reply(bucket: int, to: list[int], answers: list[np.ndarray]) -> pa.Table:
    return pa.table({"to": pa.array(to, pa.int32()), "sender": pa.array([bucket] * len(to), pa.int32()), "blob": pa.array([pack(a) for a in answers], pa.binary())})


def answered(keys: np.ndarray, buckets: int, table: pa.Table, default: int) -> np.ndarray:
    """The answers (a small number for each key sent, in order) that came back; `default` for buckets that sent none."""
    cut = to_buckets(keys, buckets)
    out = np.full(keys.size, default, np.uint8)
    for k, blob in zip(table.column("sender").to_pylist(), table.column("blob").to_pylist()):
        out[cut[k] : cut[k + 1]] = unpack(blob)[0]
    return out


def shared_keys(asked: DataFrame) -> DataFrame:
    """Answers 1 for keys that two senders have, or one has twice (rows: keys, and 1 where the sender has it twice)."""

    def run(key, table):
        senders, sent = received(table)
        keys, count = np.unique(np.concatenate([s[0] for s in sent]), return_counts=True)
        bits = [((count[np.searchsorted(keys, k)] > 1) | (twice > 0)).astype(np.uint8) for k, twice in sent]
        pick = [i for i, b in enumerate(bits) if b.any()]
        return reply(key[0].as_py(), [senders[i] for i in pick], [bits[i] for i in pick])

    return asked.groupBy("to").applyInArrow(run, BLOB)


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending runs of distinct keys with numbers become one, by binary search; of equal keys the least number stays."""
    (ka, na), (kb, nb) = a, b
    at = np.searchsorted(ka, kb)
    same = ka[np.minimum(at, ka.size - 1)] == kb
    na = na.copy()
    na[at[same]] = np.minimum(na[at[same]], nb[same])
    new = ~same
    place = at[new] + np.arange(new.sum())
    keys, nums = np.empty(ka.size + place.size, np.uint64), np.empty(ka.size + place.size, np.uint64)
    old = np.ones(keys.size, bool)
    old[place] = False
    keys[place], nums[place] = kb[new], nb[new]
    keys[old], nums[old] = ka, na
    return keys, nums


def answer_first(bucket: int, table: pa.Table) -> pa.Table:
    """A bucket's answers of first_holders()."""
    senders, sent = received(table, (0,))
    runs = [tuple(s) for s in sent]
    while len(runs) > 1:
        runs = [merge(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    keys, least = runs[0]
    bits = [(least[np.searchsorted(keys, k)] < n).astype(np.uint8) for k, n in sent]
    pick = [i for i, b in enumerate(bits) if b.any()]
    return reply(bucket, [senders[i] for i in pick], [bits[i] for i in pick])


def first_holders(asked: DataFrame) -> DataFrame:
    """Answers 1 where another sender has the key with a smaller number (rows: ascending distinct keys, their numbers)."""
    return asked.groupBy("to").applyInArrow(lambda key, table: answer_first(key[0].as_py(), table), BLOB)


def split_kinds(table: pa.Table) -> list[pa.Table]:
    """Answers of two rounds apart; those of the second carry kind 1."""
    kind = table.column("kind").to_numpy()
    return [table.filter(pa.array(kind == k)) for k in (0, 1)]


def both(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.withColumn("kind", F.lit(0)).unionAll(second.withColumn("kind", F.lit(1)))


def count(docs: DataFrame, shard_bytes: int = shared.SHARD_BYTES, text: str = "text") -> int:
    return shared.shard_count(docs, text, shard_bytes)
