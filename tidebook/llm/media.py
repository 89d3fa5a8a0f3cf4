"""Media columns: texts as 8-bit audio in a content-addressed chunk store, read back and verified.

A text's payload is its UTF-8 bytes, padded with spaces to a positive multiple of 192. A rolling gear hash over the
last 16 bytes cuts it into chunks of about 2 KiB (512 bytes to 8 KiB); a chunk's name is its 128-bit digest. Spark
joins on the digests find the chunks that several shards hold and give each one owner, by a hash; the owners send such chunks
once, and every document is rebuilt from its ordered chunk list, each chunk checked against its digest. The stored
form is a mono 8-bit WAV: a fixed 44-byte header and the payload as samples.

Edge cases: null counts as the empty text and has one block of 192 spaces; repeated ids and rows give a row each; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import shards as sh

BLOCK = 192
LEAST, MASK_BITS, MOST = 512, 11, 8192
_GEAR = (np.random.default_rng(192).integers(0, 1 << 16, 256)).astype(np.uint16)
STORED = "doc_id long, n_bytes long, recipe array<binary>, media binary"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. h[i] = sum of gear[data[i - k]] << k over the last 16 bytes, by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        g = h.copy()
        g[k:] += h[:-k] << np.uint16(k)
        h = g
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint16(16 - MASK_BITS) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            last = c
            ends.append(c)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    ends = cuts(data)
    return [(digest(x), x) for x in (data[a:b] for a, b in zip([0, *ends], ends))]


def wav(samples: bytes, rate: int = 8000) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples(media: bytes) -> bytes:
    """The samples of a stored WAV."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a stored WAV")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def feature(data: bytes) -> str:
    """Count, sum, least, most and zero crossings (about 128) of the samples, and the energy of their differences."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    sign = x >= 128
    return f"n={x.size};sum={x.sum()};min={x.min()};max={x.max()};cross={(sign[1:] != sign[:-1]).sum()};energy={(np.diff(x) ** 2).sum()}"


def texts(table: pa.Table) -> tuple[sh.Shard, list[bytes]]:
    s = sh.Shard(table)
    raw = s.buf.tobytes()
    return s, [raw[a:b] for a, b in zip(s.off[:-1].tolist(), s.off[1:].tolist())]


def rebuild(recipe: list[bytes], store: dict[bytes, bytes]) -> bytes:
    """The payload of an ordered chunk list; raises if a chunk is missing or isn't what its digest says."""
    out = []
    for d in recipe:
        chunk = store[d]
        if digest(chunk) != d:
            raise ValueError(f"chunk {d.hex()} is damaged")
        out.append(chunk)
    return b"".join(out)


def media(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document: sizes, digests of what its stored media hold, a feature string and the number of chunks."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def read(batches):
        for b in batches:
            stored = b.column("media").to_pylist()
            rows = [(len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(x), hashlib.sha256(x).hexdigest(), feature(back)) for x, back in zip(stored, map(samples, stored))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(list(c), pa.string() if i in (1, 4, 5) else pa.int64()) for i, c in enumerate(cols)), b.column("n_chunks")], names)

    return stored(docs, text).select("doc_id", "n_bytes", F.size("recipe").cast("long").alias("n_chunks"), "media").mapInArrow(read, OUT)


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """The media column: (doc_id, n_bytes of the text, recipe, media): the ordered chunk list and the WAV rebuilt from it."""
    n = sh.count(docs, text=text)
    dealt = sh.dealt(docs, n, text=text)

    def names(key, table):
        own = {d for t in texts(table)[1] for d, _ in chunks(payload(t))}
        return pa.table({"digest": pa.array(sorted(own), pa.binary()), "shard": pa.array([key[0].as_py()] * len(own), pa.int32())})

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    held = dealt.groupBy("shard").applyInArrow(names, "digest binary, shard int").repartition(parts, "digest")
    owners = held.groupBy("digest").agg(F.min_by("shard", F.xxhash64("digest", "shard")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    wanted = held.join(owners, "digest").where("shard != owner").select("shard", "digest")

    def export(key, left, right):
        want = set(right.column("digest").to_pylist())
        out = {}
        if want:
            for t in texts(left)[1]:
                for d, x in chunks(payload(t)):
                    if d in want:
                        out[d] = x
        return pa.table({"digest": pa.array(list(out), pa.binary()), "chunk": pa.array([sh.pack(np.frombuffer(x, np.uint8)) for x in out.values()], pa.binary())})

    by_owner = owners.select(F.col("owner").alias("shard"), "digest")
    store = dealt.groupBy("shard").cogroup(by_owner.groupBy("shard")).applyInArrow(export, "digest binary, chunk binary")
    imports = wanted.join(store, "digest").select("shard", "digest", "chunk")

    def read(key, left, right):
        s, raw = texts(left)
        foreign = {d: sh.unpack(x)[0].tobytes() for d, x in zip(right.column("digest").to_pylist(), right.column("chunk").to_pylist())}
        own: dict[bytes, bytes] = {}
        recipes, want = [], []
        for t in raw:
            p = payload(t)
            cut = chunks(p)
            own.update((d, x) for d, x in cut if d not in foreign)
            recipes.append([d for d, _ in cut])
            want.append(hashlib.sha256(p).digest())
        own.update(foreign)
        rows = []
        for t, recipe, sha in zip(raw, recipes, want):
            whole = wav(rebuild(recipe, own))
            if hashlib.sha256(samples(whole)).digest() != sha:
                raise ValueError("what was read back differs from what was stored")
            rows.append((len(t), recipe, whole))
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([s.id_array(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.binary())), pa.array(cols[2], pa.binary())], names=["doc_id", "n_bytes", "recipe", "media"])

    return dealt.groupBy("shard").cogroup(imports.groupBy("shard")).applyInArrow(read, STORED)
