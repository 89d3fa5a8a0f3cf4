"""Benchmark decontamination: MinHash containment search by item size, verified by exact shingle containment.

An item lies in a document if at least 80 % of its distinct 5-word shingles do (words `[^\\x20\\x09-\\x0D]+`, A-Z as
a-z; an item of fewer words has one shingle, all its words, which must follow each other in the document).

1. Items are partitioned by size. For a partition whose largest item has q shingles each item is indexed under a sketch of
   k = floor(0.2 q) + 1 of its shingles: at most 0.2 q of a contained item's are missing, so a document that contains the
   item holds at least one of any k. No contained item is missed, however long the document. Taken are the k that the
   fewest items have, by MinHash order among equals: what many items share, such as a common prompt, leads to none of
   them as long as they have k shingles of their own, so items and documents that share it make no pairs.
2. All sketches together set the bits of one Bloom filter (64 bits for each hash, 2 MB at least and 32 MB at most), the only
   thing that goes to every task. Documents are read once: those that hold a hash of the filter are written with their
   shingles and these hashes.
3. Spark joins the hashes with the sketches, and the pairs with the shingles of both sides, which are compared exactly.
   Neither items nor documents are gathered anywhere; beyond 4 million hashes the filter fills, which costs work, not results.

Edge cases: null and empty texts match nothing; empty or null items match nothing; repeated rows and ids give a row
for each; an empty benchmark gives no rows, and an empty table none; columns other than the id and text are ignored.
decontaminate() judges rows, not ids: of rows with one id or a null id those that hold an item go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import shards as sh
from tidebook.llm import textkit as tk
from tidebook.llm.shared import discard, materialize, release

PERCENT, WIDTH = 80, 5
#: Bits of the Bloom filter (powers of 2, from 2 MB to 32 MB) for each hash, and its slices.
LEAST_BITS, MOST_BITS, EACH_BITS, SLICES = 24, 28, 64, 64
#: Odd factors that give a hash its places in the filter.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
U = np.uint64


def size_class(n: np.ndarray) -> np.ndarray:
    """Partitions of sizes within a factor of sqrt(2)."""
    return np.ceil(np.log2(np.maximum(n, 1)) * 2).astype(np.int32)


def indexed(items: DataFrame) -> DataFrame:
    """(item, item_id, n_item, width, class, grams) of items that have words: width in words of a shingle; written."""

    def run(batches):
        for b in batches:
            words = np.diff(tk.word_hashes(*tk.buffers(b.column(1)), lower=True)[1])
            grams, begin = tk.shingle_sets(b.column(1), WIDTH)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            blobs = [grams[begin[i] : begin[i + 1]].tobytes() for i in some]
            cols = [pa.array(n[some], pa.int64()), pa.array(np.minimum(words, WIDTH)[some], pa.int32()), pa.array(size_class(n)[some], pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *cols], ["item_id", "n_item", "width", "class", "grams"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(run, "item_id long, n_item long, width int, class int, grams binary")
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(hash, item): of each item the k shingles that the fewest items have (least hashes among equals), k by its partition."""
    most = dict(items.groupBy("class").agg(F.max("n_item")).collect())  # two for each power of 2

    def run(batches):
        for b in batches:
            for item, c, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(own.size, item)), pa.array(np.full(own.size, most[c] * (100 - percent) // 100 + 1))], ["hash", "item", "k"])

    own = items.select("item", "class", "grams").mapInArrow(run, "hash long, item long, k long")
    seen = own.groupBy("hash").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("item").orderBy("seen", "hash")  # shingles of one item
    return own.join(seen, "hash").withColumn("_n", F.row_number().over(order)).where("_n <= k").select("hash", "item")


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places in a filter of 2^bits."""
    return [((h ^ (h >> U(29))) * U(f) >> U(64 - bits)).astype(np.int64) for f in PLACES]


def bloom(found: DataFrame) -> np.ndarray:
    """The filter of all hashes of sketches(), as bytes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (found.count() * EACH_BITS).bit_length()))

    def part(batches):
        mask = np.zeros(1 << bits, bool)
        for b in batches:
            for at in places(b.column(0).to_numpy().view(np.uint64), bits):
                mask[at] = True
        rows = [(k, sh.pack(np.packbits(x))) for k, x in enumerate(np.split(mask, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["slice", "blob"])

    def add(key, table):
        every = np.bitwise_or.reduce([sh.unpack(x)[0] for x in table.column("blob").to_pylist()])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([sh.pack(every)], pa.binary())})

    schema = "slice int, blob binary"
    some = found.select("hash").mapInArrow(part, schema).groupBy("slice", (F.rand(3) * SLICES).cast("int")).applyInArrow(add, schema)
    out = np.zeros((SLICES, (1 << bits) // 8 // SLICES), np.uint8)
    for k, x in some.groupBy("slice").applyInArrow(add, schema).collect():
        out[k] = sh.unpack(x)[0]
    return out.ravel()


def inside(h: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold; later places are looked up for those that are left."""
    ok = np.arange(h.size)
    for k in range(len(PLACES)):
        at = places(h[ok], (mask.size * 8).bit_length() - 1)[k]
        ok = ok[(mask[at >> 3] >> (7 - (at & 7)) & 1) > 0]
    out = np.zeros(h.size, bool)
    out[ok] = True
    return out


def hits(texts, mask: np.ndarray, widths: list[int]):
    """For each slice of texts (from, to, shingles of all widths with the text of each, and which of them are in the filter)."""
    for i, j in tk.slices(texts):
        words, first = tk.word_hashes(*tk.buffers(texts[i:j]), lower=True)
        grams, at = map(np.concatenate, zip(*(tk.ngrams(words, first, w) for w in widths))) if widths else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield i, j, grams, np.searchsorted(first, at, side="right") - 1, inside(grams, mask)


def marked(rows: DataFrame, mask: np.ndarray, widths: list[int]) -> DataFrame:
    """(row, uid, grams, hits) of rows (text, row) that hold a hash of the filter: their distinct shingles and these hashes; written."""

    def run(batches):
        for b in batches:
            for i, _, grams, own, hit in hits(b.column(0), mask, widths):
                some = np.unique(own[hit])
                order = np.argsort(own, kind="stable")  # widths follow each other
                grams, hit, own = grams[order], hit[order], own[order]
                edges = zip(np.searchsorted(own, some), np.searchsorted(own, some, side="right"))
                pick = [(np.unique(grams[x:y]), np.unique(grams[x:y][hit[x:y]])) for x, y in edges]
                blobs = [pa.array([x[c].tobytes() for x in pick], pa.binary()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(some + i)), *blobs], ["row", "grams", "hits"])

    kind = rows.schema["row"].dataType.simpleString()
    found = rows.select("text", "row").mapInArrow(run, f"row {kind}, grams binary, hits binary")
    return materialize(found.select("row", F.monotonically_increasing_id().alias("uid"), "grams", "hits"), "marked")


def verified(docs: DataFrame, items: DataFrame, least: DataFrame, percent: int) -> DataFrame:
    """(uid, item_id, n_item, n_shared) of pairs that share a sketch hash and enough shingles.

    What the result has of an item comes with its shingles: each join of small tables is broadcast at the same time as the others,
    and Spark's driver takes several buffers of 4 MB for every one.
    """

    def each(batches):
        for b in batches:
            for uid, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(h.size, uid))], ["hash", "uid"])

    def compare(batches):
        for b in batches:
            both = [int(np.isin(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).sum()) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            ok = 100 * np.array(both, np.int64) >= percent * b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(both, pa.int64())], ["uid", "item_id", "n_item", "n_shared"]).filter(pa.array(ok, pa.bool_()))

    pairs = docs.select("uid", "hits").mapInArrow(each, "hash long, uid long").join(least, "hash").select("uid", "item").distinct()
    sides = pairs.join(items.select("item", "item_id", "n_item", F.col("grams").alias("own")), "item").join(docs.select("uid", "grams"), "uid")
    return sides.select("uid", "item_id", "n_item", "own", "grams").mapInArrow(compare, "uid long, item_id long, n_item long, n_shared long")


def prepared(items: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, np.ndarray, list[int]]:
    own = indexed(items)
    least = materialize(sketches(own, percent), "sketches")
    return own, least, bloom(least), [r[0] for r in own.select("width").distinct().orderBy("width").collect()]  # five at most


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row (doc_id, item_id, n_item, n_shared, containment) for each item that lies in a document."""
    own, least, mask, widths = prepared(items, percent)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"))
    some = marked(rows, mask, widths)
    got = verified(some, own, least, percent).join(some.select("uid", "row"), "uid")
    return got.select("row.doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without rows in which a benchmark item lies; columns and other rows as they were.

    Rows without a hash of the filter pass as they are, in no exchange; the few others are told by a written number.
    """
    own, least, mask, widths = prepared(items, percent)
    text = docs.columns.index("text")

    def clean(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i, _, _, at, hit in hits(b.column(text).cast(pa.string()), mask, widths):
                ok[i + at[hit]] = False
            yield b.filter(pa.array(ok))

    some = marked(docs.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row")), mask, widths)
    bad = materialize(verified(some, own, least, percent).select("uid").distinct(), "contaminated")
    discard(own, least)
    release(docs.sparkSession)
    kept = some.join(bad, "uid", "left_anti").select("row.*")
    return docs.mapInArrow(clean, docs.schema).unionAll(kept)


#: The same result in DuckDB, all shingles against all items.
SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from benchmark),
i as (select distinct item_id, least(len(ws), 5) n, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda x: array_to_string(list_slice(ws, x, x + 4), ' '))) g from iw where len(ws) > 0),
n as (select item_id, count(*) n_item from i group by item_id),
k as (select distinct n from i),
d as (select distinct doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda x: array_to_string(list_slice(ws, x, x + n - 1), ' '))) g from w, k),
h as (select doc_id, item_id, cast(count(*) as bigint) n_shared from d join i using (n, g) group by all)
select doc_id, item_id, cast(n_item as bigint) n_item, n_shared, n_shared / n_item::double containment from h join n using (item_id) where 100 * n_shared >= 80 * n_item
"""
