"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike (80 % of their union), by count-vector R-trees.

1. Documents of equal sets are one class, found by a 128-bit digest of the set. A sketch of 2**20 counters, a fixed size,
   tells how many documents have a shingle that falls into a counter.
2. Shingles are put in one order, those of the smaller counters first. Of alike sets of a and b shingles, which share at
   least s = ceil(4 (a + b) / 9), the first a - s + 1 and the first b - s + 1 in this order have one in common. So a set
   needs its first n - ceil(0.8 n) + 1 only, its prefix; passages that many documents have lie at the end of the order
   and make no blocks. Prefix shingles that only one class has are dropped, by packed arrays exchanged between shards
   and hash ranges; what is left makes the blocks.
3. A shingle falls into one of 256 groups; the counts of a set's shingles in the groups are its point. In each block the
   points are indexed by an R-tree, whose nodes hold the greatest count of each group and the range of sizes. The
   overlap of two sets is at most the sum of their coordinates' minima, that of a set and a node likewise with the node's
   greatest counts; what can't reach the overlap that 80 % needs is pruned, and so are sizes too far apart and shingles
   that stand too late in the order to be the first that both have.
4. In a first round one document of each component in a block is paired with a pivot within the bound, in the next one
   each document outside the block's largest component with one partner of another component within the bound; of its
   partners in all blocks a document keeps the first. In a third round it has one of each other component, where one of both
   has several documents. The first two rounds take a few blocks of each document, those of the least hashes, which differ by round and
   are mostly the same for near copies. What is linked is contracted to components (at first each class is
   its own). In a last round all pairs of documents in different components that survive the bound in any block and have not been
   tested are verified. So a group of many near copies costs few pairs for each of them, not all pairs, and no link
   between different components is lost.
5. Pairs of longer sets are bounded once more by points of n / 4 groups, as 256 don't tell sets of thousands of shingles
   apart; those that survive are verified on whole sets.

Components are found by alternating large and small stars over written edges; nothing is collected but the sketch.

Edge cases: null and empty texts, and texts without words, have an empty set, link with nothing and keep their own id;
fewer than five words are one shingle; rows of the same id are documents of their own, each with that id; a null id
counts as the largest; an empty table gives no rows; of other columns `text` and `doc_id` alone are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import shards as sh
from tidebook.llm import textkit as tk
from tidebook.llm.shared import discard, materialize, release

U = np.uint64
PERCENT, GROUPS, FULL = 80, 256, 255
LEAF, FAN = 8, 16
#: Blocks of a document in the first two rounds.
FEW = 4
#: The sketch: counters, slices that are added up apart, and parts of a slice.
BITS, SLICES, PARTS = 20, 256, 64
#: Sets of more shingles have points of more than GROUPS groups besides.
LONG = 4 * GROUPS
#: A digest that more than this share of the rows have goes to all tasks; there are fewer than its inverse.
HOT = 0.005


def needed(a, b):
    """Shared shingles that sets of a and b shingles need."""
    return (4 * (a + b) + 8) // 9


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(sh.NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def digested(grams: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Size and 128-bit digest of each set."""
    weight = tk.mix(grams ^ U(0x9E3779B97F4A7C15))
    total = [np.r_[U(0), np.cumsum(x, dtype=np.uint64)] for x in (tk.mix(grams), weight)]
    return [np.diff(begin), *((t[begin[1:]] - t[begin[:-1]]).view(np.int64) for t in total)]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2) for each document; rows with a slice instead are counts of shingles by the task's documents."""

    def run(batches):
        count = np.zeros(1 << BITS, np.uint32)
        for b in batches:
            for i, j in tk.slices(b.column(1)):
                grams, begin = tk.shingle_sets(b.column(1)[i:j])
                cols = [pa.array(x, pa.int64()) for x in digested(grams, begin)]
                at, many = np.unique(grams >> U(64 - BITS), return_counts=True)
                count[at.astype(np.int64)] += many.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cols, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        full = [k for k, part in enumerate(np.split(count, SLICES)) if part.any()]
        blobs = pa.array([sh.pack(np.split(count, SLICES)[k]) for k in full], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(full), pa.int64()) for _ in range(4)), pa.array(full, pa.int32()), blobs], names)

    names = ["doc_id", "n", "s1", "s2", "slice", "blob"]
    return rows_of(docs).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, slice int, blob binary")


def ranks(counts: DataFrame) -> np.ndarray:
    """The place of each counter of the sketch when they are ordered by their counts: the fixed size that comes to the driver."""

    def add(key, table):
        total = np.zeros((1 << BITS) // SLICES, np.uint64)
        for x in table.column("blob").to_pylist():
            total += sh.unpack(x)[0]
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([sh.pack(total)], pa.binary())})

    some = counts.where("slice is not null").select("slice", "blob")
    some = some.groupBy("slice", (F.rand(7) * PARTS).cast("int").alias("part")).applyInArrow(add, "slice int, blob binary")
    total = np.zeros((SLICES, (1 << BITS) // SLICES), np.uint64)
    for k, blob in some.groupBy("slice").applyInArrow(add, "slice int, blob binary").collect():
        total[k] = sh.unpack(blob)[0]
    place = np.empty(1 << BITS, np.uint32)
    place[np.argsort(total.ravel(), kind="stable")] = np.arange(1 << BITS, dtype=np.uint32)
    return place


def ordered(grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the order of the sketch: a hash's upper bits give way to the place of its counter, one to one."""
    return (place[(grams >> U(64 - BITS)).astype(np.int64)].astype(np.uint64) << U(64 - BITS)) | (grams & U((1 << 64 - BITS) - 1))


def width(n: int) -> int:
    """Groups, a power of two, of the point of a set of more than LONG shingles."""
    return 1 << max(7, (n // 4 - 1).bit_length())


def classes_of(docs: DataFrame, place: np.ndarray) -> DataFrame:
    """(node, doc_id, copies, n, s1, s2, prefix, point, fine) of each distinct set that isn't empty."""

    def run(batches):
        for b in batches:
            for i, j in tk.slices(b.column(1)):
                grams, begin = tk.shingle_sets(b.column(1)[i:j])
                n, s1, s2 = digested(grams, begin)
                own = np.repeat(np.arange(j - i), n)
                point = np.bincount(own * GROUPS + (grams & U(GROUPS - 1)).astype(np.int64), minlength=(j - i) * GROUPS)
                point = np.minimum(point, FULL).astype(np.uint8).reshape(-1, GROUPS)
                key = ordered(grams, place)
                prefix, fine = [], []
                for k, m in enumerate(n.tolist()):
                    a, z = begin[k], begin[k + 1]
                    p = prefix_length(m)
                    first = np.partition(key[a:z], p - 1)[:p] if m > p else key[a:z].copy()
                    first.sort()
                    prefix.append(first.tobytes())
                    fine.append(sh.pack(np.minimum(np.bincount((grams[a:z] & U(width(m) - 1)).astype(np.int64), minlength=width(m)), FULL).astype(np.uint8)) if m > LONG else None)
                cols = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *cols, pa.array(prefix, pa.binary()), pa.array([x.tobytes() for x in point], pa.binary()), pa.array(fine, pa.binary())], names)

    names = ["doc_id", "n", "s1", "s2", "prefix", "point", "fine"]
    sets = rows_of(docs).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix binary, point binary, fine binary").where("n > 0")
    one = sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first(F.struct("prefix", "point", "fine")).alias("p"))
    return one.select(F.monotonically_increasing_id().alias("node"), "doc_id", "copies", "n", "s1", "s2", "p.prefix", "p.point", "p.fine")


def shared_prefixes(classes: DataFrame, shards: int) -> DataFrame:
    """(node, n, keys, pos, point) of classes that share a prefix shingle with another class.

    keys: the shared shingles, mixed, as prefixes are the least numbers and buckets equal ranges; pos: their places in the
    set's order. A shingle counts as shared if two sets have it and one of them among the first it can share with a
    larger set, n - ceil(8 n / 9) + 1.
    """
    parts = min(shards, 4 * max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    dealt = classes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "n", "prefix", "point").repartition(parts, "shard")

    def opened(table):
        keys = [tk.mix(np.frombuffer(x, np.uint64)) for x in table.column("prefix").to_pylist()]
        n = table.column("n").to_numpy()
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        early = np.concatenate([np.arange(k.size) <= m - needed(m, m) for k, m in zip(keys, n)]) if keys else np.zeros(0, bool)
        distinct, inv, count = np.unique(every, return_inverse=True, return_counts=True)
        return keys, distinct, (count > 1).astype(np.uint8) | (np.bincount(inv, early, distinct.size) > 0).astype(np.uint8) << 1

    def ask(key, table):
        _, distinct, bits = opened(table)
        return sh.send(key[0].as_py(), distinct, shards, bits)

    def answer(key, table):
        senders, sent = sh.received(table)
        keys, inv, count = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True, return_counts=True)
        bits = np.concatenate([s[1] for s in sent])
        shared = ((count > 1) | (np.bincount(inv, bits & 1) > 0)) & (np.bincount(inv, bits >> 1) > 0)
        got = np.split(shared[inv].astype(np.uint8), np.cumsum([s[0].size for s in sent])[:-1])
        pick = [i for i, b in enumerate(got) if b.any()]
        return sh.reply(key[0].as_py(), [senders[i] for i in pick], [got[i] for i in pick])

    def keep(key, left, right):
        keys, distinct, _ = opened(left)
        shared = sh.answered(distinct, shards, right, 0) > 0
        pos = [np.flatnonzero(shared[np.searchsorted(distinct, k)]).astype(np.uint32) for k in keys]
        pick = [i for i, p in enumerate(pos) if p.size]
        rows = left.take(pa.array(pick, pa.int64()))
        blobs = [pa.array([x(i) for i in pick], pa.binary()) for x in (lambda i: keys[i][pos[i]].tobytes(), lambda i: pos[i].tobytes())]
        return pa.table([rows.column("node"), rows.column("n"), *blobs, rows.column("point")], names=["node", "n", "keys", "pos", "point"])

    shared = dealt.groupBy("shard").applyInArrow(ask, sh.BLOB).groupBy("to").applyInArrow(answer, sh.BLOB)
    return dealt.groupBy("shard").cogroup(shared.groupBy("to")).applyInArrow(keep, "node long, n long, keys binary, pos binary, point binary")


def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of the coordinates' minima of points (broadcast); a full count may stand for any larger one."""
    least = np.minimum(p, q)
    full = least.size and least.max() == FULL
    sums = least.sum(-1, dtype=np.uint32).astype(np.int64)
    return np.where((least == FULL).any(-1), np.iinfo(np.int64).max, sums) if full else sums


class RTree:
    """The points of a block, packed by size, then by their most varied coordinate, into leaves and up to two levels of nodes above.

    A block of no more than LEAF points is one leaf, whose bounds are taken at once.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        """rest: shingles from the block's shared one to the end of the set's order, an upper bound of what a pair shares."""
        order = np.argsort(sizes, kind="stable")
        for a in range(0, order.size if order.size > LEAF else 0, LEAF * FAN):
            own = order[a : a + LEAF * FAN]
            axis = int(points[own].astype(np.int32).var(0).argmax())
            order[a : a + LEAF * FAN] = own[np.argsort(points[own, axis], kind="stable")]
        self.order, self.points, self.sizes, self.rest = order, points[order], sizes[order], rest[order]
        self.at = np.empty(order.size, np.int64)
        self.at[order] = np.arange(order.size)
        self.levels = []
        for step in (LEAF * FAN, LEAF):
            if order.size > step:
                at = np.arange(0, order.size, step)
                self.levels.append((step, np.maximum.reduceat(self.points, at, axis=0), np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at), np.maximum.reduceat(self.rest, at)))
        if not self.levels:
            need = needed(sizes[:, None], sizes)
            self.leaf = (5 * sizes[:, None] >= 4 * sizes) & (4 * sizes[:, None] <= 5 * sizes) & (np.minimum(rest[:, None], rest) >= need)
            self.leaf &= bound(points[:, None], points) >= need

    @staticmethod
    def near(point, size, rest, hi, low, high, most):
        """Which nodes (or points: low is high) may hold a set alike to one of this point, size and rest."""
        need = needed(size, np.maximum(low, (4 * size + 4) // 5))
        ok = np.flatnonzero((5 * high >= 4 * size) & (4 * low <= 5 * size) & (np.minimum(rest, most) >= need))
        return ok[bound(point, hi[ok]) >= need[ok]]

    def search(self, k: int) -> np.ndarray:
        """Indexes of the points within the bound of the k-th."""
        if not self.levels:
            return np.flatnonzero(self.leaf[k])
        i = self.at[k]
        own = self.points[i], int(self.sizes[i]), int(self.rest[i])
        rows = np.arange(self.order.size)
        for step, *node in self.levels:
            nodes = np.unique(rows // step)
            nodes = nodes[self.near(*own, *(x[nodes] for x in node))]
            rows = (nodes[:, None] * step + np.arange(step)).ravel()
            rows = rows[rows < self.order.size]
        return self.order[rows[self.near(*own, self.points[rows], self.sizes[rows], self.sizes[rows], self.rest[rows])]]


def rank(nodes: np.ndarray, salt: int = 0) -> np.ndarray:
    """The order of pivots in a round: a hash of the node, the same in all blocks, so that blocks agree on most pairs."""
    return tk.mix(np.asarray(nodes).astype(np.uint64) + U(salt * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def pivots(nodes, sizes, rest, points, label, salt: int = 0) -> list[tuple[int, int]]:
    """Pairs (pivot, other) that cover the first document of each component: each but pivots is the partner of the first pivot within the bound."""
    order = np.lexsort((rank(nodes, salt), label))
    lead = order[np.r_[True, label[order][1:] != label[order][:-1]]]
    if lead.size < 2:
        return []
    nodes = nodes[lead]
    tree = RTree(points[lead], sizes[lead], rest[lead])
    alive = np.ones(nodes.size, bool)
    out = []
    for k in np.argsort(rank(nodes, salt), kind="stable"):
        if alive[k]:
            alive[k] = False
            near = tree.search(k)
            near = near[alive[near]]
            alive[near] = False
            out += [(int(nodes[k]), int(x)) for x in nodes[near]]
    return out


def crossing(nodes, sizes, rest, points, label) -> list[tuple[int, int]]:
    """Pairs within the bound of documents of different components; searched from all but the largest component."""
    names, inv, count = np.unique(label, return_inverse=True, return_counts=True)
    if names.size == 1:
        return []
    tree = RTree(points, sizes, rest)
    largest = count.argmax()
    out = []
    for k in np.flatnonzero(inv != largest):
        near = tree.search(k)
        near = near[(inv[near] != inv[k]) & ((inv[near] == largest) | (near > k))]
        out += [(int(nodes[k]), int(x)) for x in nodes[near]]
    return out


def partners(nodes, sizes, rest, points, label, salt: int = 0) -> list[tuple[int, int]]:
    """Pairs (partner, document) for documents outside the largest component: any one of another component within the bound."""
    names, inv, count = np.unique(label, return_inverse=True, return_counts=True)
    if names.size == 1:
        return []
    tree = RTree(points, sizes, rest)
    out = []
    for k in np.flatnonzero(inv != count.argmax()):
        near = tree.search(k)
        near = near[inv[near] != inv[k]]
        if near.size:
            out.append((int(nodes[near[rank(nodes[near] ^ nodes[k], salt).argmin()]]), int(nodes[k])))
    return out


def apart(nodes, sizes, rest, points, label, salt: int = 0) -> list[tuple[int, int]]:
    """Pairs (partner, document) for documents outside the largest component: one of each other component within the bound, if one of both has several."""
    names, inv, count = np.unique(label, return_inverse=True, return_counts=True)
    if names.size == 1 or count.max() == 1:
        return []
    tree = RTree(points, sizes, rest)
    out = []
    for k in np.flatnonzero(inv != count.argmax()):
        near = tree.search(k)
        near = near[(inv[near] != inv[k]) & ((count[inv[near]] > 1) | (count[inv[k]] > 1))]
        near = near[np.lexsort((rank(nodes[near] ^ nodes[k], salt), inv[near]))]
        near = near[np.r_[True, np.diff(inv[near]) != 0]] if near.size else near
        out += [(int(x), int(nodes[k])) for x in nodes[near]]
    return out


#: What pairs documents in the rounds before the last.
ROUNDS = (pivots, partners, apart)


def pairs(cands: DataFrame, shards: int, salt: int | None, pick=None) -> DataFrame:
    """Candidate pairs from candidates (node, n, keys, pos, point, label): distinct (a, b) with a < b.

    With pivots or partners, from FEW blocks of each document, it has one pair at most besides those in which it is the first,
    with `apart` one for each component and block; without a pick, there are all pairs of different components within the bound.
    """
    parts = min(shards, 4 * max(int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))

    one = pick not in (None, apart)

    def entries(batches):
        for b in batches:
            keys = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            if not keys:
                continue
            every, own = np.concatenate(keys), np.repeat(np.arange(len(keys)), [k.size for k in keys])
            if not one:
                order = np.argsort(every, kind="stable")
            else:
                order = np.lexsort((tk.mix(every ^ U(0xD6E8FEB86659FD93 * (salt + 1) % (1 << 64))), own))
                order = order[np.arange(own.size) - np.searchsorted(own, own) < FEW]
                order = order[np.argsort(every[order], kind="stable")]
            key, who = every[order], own[order]
            pos = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32)[order]
            points = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, GROUPS)
            nodes, n, label = (b.column(i).to_numpy() for i in (0, 1, 5))
            cut = sh.to_buckets(key, shards)
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                u, w = np.unique(who[s], return_inverse=True)  # a document once for each bucket
                blob = sh.pack(key[s], w.astype(np.uint32), pos[s], nodes[u], n[u], label[u], points[u].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["to", "blob"])

    def block(key, table):
        parts = [sh.unpack(x) for x in table.column("blob").to_pylist()]
        shift = np.cumsum([0] + [p[3].size for p in parts])
        keys, pos, nodes, n, label = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4, 5))
        who = np.concatenate([p[1] + s for p, s in zip(parts, shift)])
        points = np.concatenate([p[6].reshape(-1, GROUPS) for p in parts])
        order = np.lexsort((nodes[who], keys))
        keys, who, rest = keys[order], who[order], n[who[order]] - pos[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begin, keys.size])
        out, seen = set(), set()
        two = begin[size == 2]
        if two.size:
            a, b, least = who[two], who[two + 1], np.minimum(rest[two], rest[two + 1])
            need = needed(n[a], n[b])
            ok = (4 * np.maximum(n[a], n[b]) <= 5 * np.minimum(n[a], n[b])) & (label[a] != label[b]) & (least >= need)
            a, b = a[ok], b[ok]
            ok = bound(points[a], points[b]) >= need[ok]
            a, b = nodes[a[ok]], nodes[b[ok]]
            first = rank(a, salt or 0) < rank(b, salt or 0)
            out.update(zip(np.where(first, a, b).tolist(), np.where(first, b, a).tolist()))
        more = np.flatnonzero(size > 2)
        for k in more[np.argsort(-rest[begin[more]], kind="stable")]:  # of blocks of the same documents the first in the order counts
            s = slice(begin[k], begin[k] + size[k])
            w = who[s]
            own = w.tobytes()
            if own in seen:
                continue
            seen.add(own)
            block = nodes[w], n[w], rest[s], points[w], label[w]
            out.update(crossing(*block) if pick is None else pick(*block, salt))
        best: dict[int, tuple] = {}
        if one:  # of a document's pivots the first
            pivot = np.array([p for p, _ in out], np.int64)
            for (p, x), r in zip(list(out), rank(pivot, salt).tolist()):
                best[x] = min(best.get(x, (r, p)), (r, p))
            out = {(p, x) for x, (_, p) in best.items()}
        rows = np.array(sorted((p, x) if one else (min(p, x), max(p, x)) for p, x in out), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(rows[:, 0]), "b": pa.array(rows[:, 1]), "r": pa.array(rank(rows[:, 0], salt or 0))})

    rows = cands.select("node", "n", "keys", "pos", "point", "label").mapInArrow(entries, "to int, blob binary").repartition(parts, "to")
    found = rows.groupBy("to").applyInArrow(block, "a long, b long, r long")
    if not one:
        return found.select("a", "b").distinct()
    return found.groupBy("b").agg(F.min_by("a", "r").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within_fine(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs but those of two long sets whose points of more groups bound the overlap too low; these are sent instead of whole sets."""

    def folded(x, groups):
        return x.reshape(-1, groups).sum(0, dtype=np.uint32)

    def run(batches):
        for t in batches:
            ok = []
            for x, y, n, m in zip(*(t.column(i).to_pylist() for i in (2, 4, 3, 5))):
                p, q = sh.unpack(x)[0], sh.unpack(y)[0]
                if p.max() == FULL or q.max() == FULL:
                    ok.append(True)
                    continue
                groups = min(p.size, q.size)
                ok.append(int(np.minimum(folded(p, groups), folded(q, groups)).sum()) >= needed(n, m))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sets.where("fine is not null").select(F.col("node").alias(c), F.col("fine").alias(f"{c}_fine"), F.col("n").alias(f"{c}_n"))
    both = found.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "a_fine", "a_n", "b_fine", "b_n")
    long = F.col("a_n").isNotNull() & F.col("b_n").isNotNull()
    return both.where(~long).select("a", "b").unionAll(both.where(long).mapInArrow(run, "a long, b long"))


def whole_sets(docs: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """(node, grams): the sets of the classes in pairs, by the upper 48 bits of their shingles' hashes.

    Sets are compared in pairs only, so that among a thousand shingles two collide with a probability of 4e-9. Texts are
    found by the class's id, then told by their digest; rows without an id by their digest alone.
    """

    def run(batches):
        for b in batches:
            for i, j in tk.slices(b.column(0)):
                grams, begin = tk.shingle_sets(b.column(0)[i:j])
                n, s1, s2 = digested(grams, begin)
                blobs = pa.array([sh.pack(sh.planes(np.diff(grams[a:z] >> U(16), prepend=U(0)))) for a, z in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(1)[i:j], *(pa.array(x, pa.int64()) for x in (n, s1, s2)), blobs], ["doc_id", *on, "grams"])

    on = ["n", "s1", "s2"]
    opened = lambda some: some.select("text", "doc_id").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, grams binary")
    ends = found.select(F.col("a").alias("node")).unionAll(found.select("b")).distinct()
    own = sets.select("node", "doc_id", *on).join(ends, "node", "left_semi")
    rows = rows_of(docs)
    ids = own.where(F.col("doc_id") != sh.NO_ID).select("doc_id").distinct()
    named = opened(rows.where(F.col("doc_id") != sh.NO_ID).join(ids, "doc_id", "left_semi")).join(own, ["doc_id", *on]).select("node", "grams")
    rest = opened(rows.where(F.col("doc_id") == sh.NO_ID)).join(own.where(F.col("doc_id") == sh.NO_ID).drop("doc_id"), on).select("node", "grams")
    return named.unionAll(rest).groupBy("node").agg(F.first("grams").alias("grams"))  # rows may repeat an id and a set


def linked(found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose sets are alike."""

    def run(batches):
        opened = lambda x: np.cumsum(sh.from_planes(sh.unpack(x)[0]), dtype=np.uint64)
        for t in batches:
            last, one, ok = None, None, []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                if x != last:
                    last, one = x, opened(x)
                two = opened(y)
                both = np.intersect1d(one, two, assume_unique=True).size
                ok.append(100 * both >= percent * (one.size + two.size - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = found.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("one")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("two")), "b").select("a", "b", "one", "two")
    return both.mapInArrow(run, "a long, b long")


def tested(docs: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """The linked ones of candidate pairs, written."""
    near = materialize(within_fine(found, sets), "near")
    whole = materialize(whole_sets(docs, sets, near), "shingles")
    release(docs.sparkSession)
    links = materialize(linked(near, whole), "links")
    discard(near, whole)
    release(docs.sparkSession)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component as root, for all nodes but roots; written.

    Large and small stars in turn (Kiveris and others, 2014) until nothing changes; a round is written each time.
    """
    state = None
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionAll(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, component, lead) for every row of docs (doc_id, text); a null id is NO_ID.

    component: the smallest id of its component; lead: whether its set is the one that stands for the component.
    """
    spark = docs.sparkSession
    shards = sh.count(docs)
    rows = materialize(digests(docs), "digests")
    sets = materialize(classes_of(docs, ranks(rows)), "classes")
    cands = materialize(shared_prefixes(sets, shards), "candidates")
    release(spark)
    names, roots, written = cands.withColumn("label", F.col("node")), None, []
    for salt, pick in enumerate((*ROUNDS, None)):
        found = pairs(names, shards, None if pick is None else salt, pick)
        for done in written:
            found = found.join(done, ["a", "b"], "left_anti")
        found = materialize(found, "pairs")
        release(spark)
        if found.isEmpty():
            discard(found)
            continue
        written.append(found)
        links = tested(docs, sets, found)
        last = roots
        roots = components(links if roots is None else links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(links, *([] if last is None else [last]))
        names = cands.join(roots, "node", "left").select("node", "n", "keys", "pos", "point", F.coalesce("root", "node").alias("label"))
    discard(cands, *written)
    own = sets.select("node", "doc_id", "copies", "n", "s1", "s2")
    if roots is None:
        own = own.select("*", F.col("node").alias("root"))
    else:
        own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("f"))
    named = own.join(first, "root").select("s1", "s2", "n", "copies", F.col("f.doc_id").alias("component"), (F.col("f.node") == F.col("node")).alias("lead"))
    named = materialize(named, "components")
    discard(sets, *([] if roots is None else [roots]))
    release(spark)
    rows = rows.where("slice is null").select("doc_id", "n", "s1", "s2")
    # digests that many rows have don't go through the join by digest; their number is bounded by the share asked for
    hot = F.broadcast(named.where(F.col("copies") > HOT * rows.count()))
    on = ["s1", "s2", "n"]
    out = ["doc_id", "n", "s1", "s2", "component", "lead"]
    full = rows.where("n > 0")
    empty = rows.where("n = 0").select("doc_id", "n", "s1", "s2", F.col("doc_id").alias("component"), F.lit(True).alias("lead"))
    often = full.join(hot, on).select(out)
    rest = full.join(hot, on, "left_anti").join(named, on).select(out)
    return empty.unionAll(often).unionAll(rest)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text)."""
    null = lambda c: F.when(F.col(c) != sh.NO_ID, F.col(c))
    return members(docs).select(null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that of the smallest id; of rows of this id and set one stays.

    Documents without words are alike to none: all their rows stay.
    """

    def run(batches):
        for b in batches:
            n, s1, s2 = (np.concatenate(x) for x in zip(*(digested(*tk.shingle_sets(b.column(1)[i:j])) for i, j in tk.slices(b.column(1))))) if b.num_rows else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n, s1, s2))], names)

    names = ["doc_id", "row", "n", "s1", "s2"]
    own = members(docs.select("doc_id", "text"))
    per_id = own.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("lead") & (F.col("doc_id") == F.col("component"))).alias("stay"))
    ids = materialize(per_id.where("stay > 0").select("doc_id", "rows"), "kept")
    one, several = (ids.where(c).select(F.col("doc_id").alias("_kept")) for c in ("rows = 1", "rows > 1"))
    number = F.coalesce(docs["doc_id"].cast("long"), F.lit(sh.NO_ID))
    kept = docs.join(one, number == one["_kept"], "left_semi")
    if several.isEmpty():
        return kept
    # which rows of a repeated id stay depends on their sets as well
    leads = own.where(F.col("lead") & (F.col("doc_id") == F.col("component"))).select("doc_id", "n", "s1", "s2").distinct()
    more = docs.join(several, number == several["_kept"], "left_semi")
    keyed = more.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(sh.NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    kind = keyed.schema["row"].dataType.simpleString()
    rows = keyed.mapInArrow(run, f"doc_id long, row {kind}, n long, s1 long, s2 long").join(leads, ["doc_id", "n", "s1", "s2"], "left_semi")
    again = rows.where("n = 0").unionAll(rows.where("n > 0").dropDuplicates(["doc_id", "n", "s1", "s2"]))
    return kept.unionAll(again.select("row.*"))


#: The same result in DuckDB: pairs by shared shingles, components by repeated expansion.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda x: array_to_string(list_slice(ws, x, x + 4), ' '))) end sh from w),
n as (select doc_id, len(sh) n from s),
g as (select doc_id, n, unnest(sh) g from s join n using (doc_id)),
o as (select a.doc_id a, b.doc_id b, count(*) k from g a join g b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
l as (select a, b from o join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a x, b y from l union all select b, a from l),
r as (select doc_id x, doc_id y from n union select r.x, e.y from r join e on r.y = e.x),
c as (select x doc_id, min(y) component_id from r group by x)
select doc_id, cast(n as bigint) n_shingles, component_id from n join c using (doc_id)
"""
