"""Byte deduplication with suffix arrays: each byte of a 100-byte string that also starts earlier is removed.

Documents lie in shards. Four steps, of which the middle two exchange packed arrays between shards and hash ranges:

1. Each 100-byte window has a minimizer, the place of the least hash among its 20-byte strings; windows with the same
   minimizer form a stretch of at most 81 starts. Equal windows have equal minimizers, so only stretches with the same
   20 bytes can share windows. A shard sends for each distinct stretch the hash of its minimizer, of its whole text and
   its smallest document.
2. The hash ranges answer: a stretch whose whole text starts earlier elsewhere goes; a stretch whose minimizer no other
   text has stays; the first of several different stretches around the same minimizer is left open.
3. The open stretches of a shard, the rims of repeated passages mostly, get a suffix array by Larsson and Sadakane's
   refinement in numpy (ranks of 8 bytes, then doubling, only groups that are still tied are sorted again), and Kasai's
   common prefixes, computed in stripes side by side. Suffixes that share 100 bytes are neighbours; the first in the
   text stands for them. Its windows form a run in order of their hash; the runs of all shards are merged by binary search.
4. Windows that another shard has in a smaller document, or the shard itself earlier, go; what they cover is removed.
   What a shard has found is not worked out again: the runs that go anyway and the places of its open windows travel
   with the messages of step 3 and come back with the answers.

Windows, stretches and minimizers are compared by 64-bit hashes (minimizers by their upper 48 bits, where a collision
only costs work). Strings are judged on the input.

Edge cases: a null text is empty; texts under 100 bytes lose nothing; a text that repeats itself keeps its first copy;
rows of the same id follow each other by their text; a null id counts as the largest; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import shards as sh
from tidebook.llm import textkit as tk

U = np.uint64
LENGTH, GRAM = 100, 20
SPREAD = LENGTH - GRAM + 1
LOW = U(0xFFFF)
STAYS, GOES, OPEN = 0, 1, 2
OWN = -1
KEPT = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("blob", pa.binary())])
OUT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def loads(buf: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes, the first being the most significant; zeros after the end."""
    v = np.zeros(buf.size + 8, np.uint64)
    v[: buf.size] = buf
    for k in (1, 2, 4):
        w = v << U(8 * k)
        w[:-k] |= v[k:]
        v = w
    return v


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i:i + width], by doubling."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[: x.size - k], x[k:])
        k *= 2
    return np.minimum(x[: x.size - (width - k)], x[width - k :]) if width > k else x


def suffix_array(buf: np.ndarray, end: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their suffixes, and their ranks; end[i]: where the suffix of place i stops.

    Larsson and Sadakane's refinement: ranks by the first h bytes are refined by the ranks h further on, h doubles,
    and only places that share a rank are sorted again. Suffixes alike in `depth` bytes may stay tied, in text order.
    """
    n = buf.size
    place = np.arange(n)
    room = np.minimum(end - place, 8).astype(np.uint64)
    key = loads(buf)[:n]
    key &= ~(((U(1) << (U(8) * (U(8) - room) % U(64))) - U(1)) * (room < U(8)).astype(np.uint64))
    order = np.lexsort((room, key))
    key, room = key[order], room[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (room[1:] != room[:-1])] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0)) if n else rank
    h = 8
    tied = ~(new & np.r_[new[1:], True]) if n else new
    while h < depth and tied.any():
        at = np.flatnonzero(tied)
        who = order[at]
        ahead = who + h
        nxt = np.where(ahead < end[who], rank[np.minimum(ahead, n - 1)], -1)
        group = rank[who]
        o = np.lexsort((who, nxt, group))
        who, nxt, group = who[o], nxt[o], group[o]
        order[at] = who
        start = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        rank[who] = np.maximum.accumulate(np.where(start, at, 0))
        alone = start & np.r_[start[1:], True]
        tied[at[alone]] = False
        h *= 2
    return order, rank


def common_prefixes(buf: np.ndarray, end: np.ndarray, order: np.ndarray, most: int = LENGTH, stripe: int = 256) -> np.ndarray:
    """Bytes, up to `most`, that each suffix in order shares with the one before: Kasai's walk over the text.

    The next place's prefix is shorter by one at most, if the place after the predecessor also comes before it. In an
    order by the first bytes alone (`most` at least) tied places may be followed by places in the other order; there the
    walk starts from nothing. Stripes of the text are walked side by side, each from nothing.
    """
    n = buf.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.empty(n + 1, np.int64)
    at[order], at[n] = np.arange(n), n
    room = np.minimum(end - np.arange(n), most)
    shared = np.zeros(n, np.int64)
    base = np.arange(0, n, stripe)
    h = np.zeros(base.size, np.int64)
    pad = np.r_[buf, np.zeros(1, np.uint8)]
    for t in range(min(stripe, n)):
        i = base + t
        i = i[i < n]
        h = np.maximum(h[: i.size] - 1, 0)
        if t:
            h[at[before[i - 1] + 1] >= at[i]] = 0
        j = before[i]
        limit = np.where(j >= 0, np.minimum(room[i], room[np.maximum(j, 0)]), 0)
        h = np.minimum(h, limit)
        live = np.flatnonzero(h < limit)
        while live.size:
            same = pad[i[live] + h[live]] == pad[j[live] + h[live]]
            live = live[same]
            h[live] += 1
            live = live[h[live] < limit[live]]
        shared[i] = h
    return shared[order]


class Stretches:
    """The stretches of a shard: windows at first[k]..last[k] have their minimizer at least[k]."""

    def __init__(self, table: pa.Table):
        self.docs = sh.Shard(table)
        buf, off = self.docs.buf, self.docs.off
        self.mixed = tk.mix(loads(buf))
        size = np.diff(off)
        firsts, lasts, leasts = [np.zeros(0, np.int64)] * 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _runs(off):
            a, b = int(off[i]), int(off[j])
            if b - a < LENGTH:
                continue
            gram = self.gram(np.arange(a, b - GRAM + 1)) >> U(32) << U(32) | np.arange(b - a - GRAM + 1, dtype=np.uint64)
            least = (sliding_least(gram, SPREAD) & U(0xFFFFFFFF)).astype(np.int64)
            ok = np.zeros(b - a + 1, np.int32)
            long = np.flatnonzero(size[i:j] >= LENGTH) + i
            ok[off[long] - a] += 1
            ok[off[long + 1] - a - LENGTH + 1] -= 1
            starts = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
            if not starts.size:
                continue
            m = least[starts]
            new = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (np.diff(starts) != 1)])
            firsts.append(starts[new] + a)
            lasts.append(starts[np.r_[new[1:], starts.size] - 1] + a)
            leasts.append(m[new] + a)
        self.first, self.last, self.least = map(np.concatenate, (firsts, lasts, leasts))
        self.own = np.searchsorted(off, self.first, side="right") - 1
        text = tk.mix(window_hashes(self.mixed, self.first) * U(3) + window_hashes(self.mixed, self.last) * U(5) + (self.last - self.first).astype(np.uint64) + ((self.least - self.first).astype(np.uint64) << U(32)))
        key = tk.mix(self.gram(self.least)) & ~LOW  # minimizers are small hashes: mixed, they spread over all ranges
        order = np.lexsort((text, key))  # stable: earlier places first
        k, t = key[order], text[order]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]) if k.size else np.zeros(0, np.int64)
        self.keys, self.texts, self.firsts = k[new], t[new], order[new]
        self.which = np.empty(k.size, np.int64)
        self.which[order] = np.repeat(np.arange(new.size), np.diff(np.r_[new, k.size]))

    def gram(self, at: np.ndarray) -> np.ndarray:
        m = self.mixed
        return tk.mix(m[at] * U(0x9E3779B97F4A7C15) + m[at + 8] * U(0xC2B2AE3D27D4EB4F) + m[at + 12])

    def ids(self, stretches: np.ndarray) -> np.ndarray:
        return self.docs.ids[self.own[stretches]]

    def states(self, answer: np.ndarray) -> np.ndarray:
        """STAYS, GOES or OPEN for every stretch: but for the first of its text in the shard, all go."""
        state = np.full(self.first.size, GOES, np.uint8)
        state[self.firsts] = answer
        return state

    def open_windows(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the open windows that repeat an earlier one of the shard, and of those that are the first of their text, ascending."""
        k = np.flatnonzero(state == OPEN)
        none = np.zeros(0, np.int64)
        if not k.size:
            return none, none
        first, last = self.first[k], self.last[k]
        at = np.repeat(first - np.r_[0, np.cumsum(last - first + 1)[:-1]], last - first + 1) + np.arange((last - first + 1).sum())
        apart = np.r_[True, first[1:] >= last[:-1] + LENGTH]  # texts that overlap are one region
        begin = first[apart]
        stop = last[np.r_[np.flatnonzero(apart)[1:] - 1, k.size - 1]] + LENGTH
        size = stop - begin
        shift = begin - np.r_[0, np.cumsum(size)[:-1]]
        region = np.repeat(np.arange(begin.size), size)
        text = self.docs.buf[np.arange(size.sum()) + shift[region]]
        end = np.cumsum(size)[region]
        local = at - shift[np.searchsorted(begin, at, side="right") - 1]
        order, _ = suffix_array(text, end)
        shared = common_prefixes(text, end, order)
        group = np.cumsum(shared < LENGTH)  # neighbours that share all 100 bytes
        mine = np.zeros(text.size, bool)
        mine[local] = True
        inside = mine[order]
        place, group = order[inside], group[inside]
        o = np.lexsort((place, group))
        place, group = place[o], group[o]
        lead = np.r_[True, group[1:] != group[:-1]]
        back = place + shift[region[place]]
        return np.sort(back[~lead]), np.sort(back[lead])

    def gone(self, state: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which bytes the stretches that go and these windows cover."""
        count = np.zeros(self.docs.buf.size + 1, np.int32)
        k = np.flatnonzero(state == GOES)
        np.add.at(count, self.first[k], 1)
        np.add.at(count, self.last[k] + LENGTH, -1)
        return covered(count, windows)


def window_hashes(mixed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the 100-byte strings at these places, from mix(loads())."""
    h = np.zeros(at.size, np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h = h * U(0xD1342543DE82EF95) + mixed[at + k]
    return tk.mix(h)


def by_hash(docs: sh.Shard, mixed: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows at these places in order of their hash: hashes, places, ids."""
    h = window_hashes(mixed, places)
    order = np.argsort(h, kind="stable")
    places = places[order]
    return h[order], places, docs.ids[np.searchsorted(docs.off, places, side="right") - 1]


def covered(count: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Bytes with a count above 0 (given as changes) or in one of the windows."""
    np.add.at(count, windows, 1)
    np.add.at(count, windows + LENGTH, -1)
    return np.cumsum(count[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2].astype(np.int32), edge[1::2].astype(np.int32)


def removed(docs: sh.Shard, gone: np.ndarray) -> list[pa.Array]:
    """Sizes, removed runs and what is left of each document."""
    n, off, keep = docs.buf.size, docs.off, ~gone
    left = np.r_[0, np.cumsum(keep)]
    opens = gone.copy()
    opens[1:] &= keep[:-1]
    edge = off[:-1][off[:-1] < n]
    opens[edge] = gone[edge]
    closes = gone.copy()
    closes[:-1] &= keep[1:]
    edge = off[1:][off[1:] > 0] - 1
    closes[edge] = gone[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    begin = off[np.searchsorted(off, start, side="right") - 1]
    runs = pa.StructArray.from_arrays([pa.array(start - begin), pa.array(end - begin)], ["start", "end"])
    at = np.r_[0, np.cumsum(opens)][off].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), off.size - 1, [None, pa.py_buffer(left[off].astype(np.int32)), pa.py_buffer(docs.buf[keep].tobytes())])
    return [pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(at), runs), kept]


def _runs(off: np.ndarray, limit: int = 1 << 19):
    i, n = 0, off.size - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def compare(asked: DataFrame) -> DataFrame:
    """Answers STAYS, GOES or OPEN for stretches (rows: keys in ascending order, texts, smallest ids)."""

    def run(key, table):
        senders, sent = sh.received(table, (0, 1))
        keys, texts, ids = (np.concatenate([s[i] for s in sent]) for i in range(3))
        order = np.lexsort((ids, texts, keys))
        k, t = keys[order], texts[order]
        lead = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]  # the smallest id of each text
        group = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        several = np.bincount(group, weights=lead)[group] > 1
        state = np.empty(keys.size, np.uint8)
        state[order] = np.where(~lead, GOES, np.where(several, OPEN, STAYS))
        parts = np.split(state, np.cumsum([s[0].size for s in sent])[:-1])
        pick = [i for i, p in enumerate(parts) if p.any()]
        return sh.reply(key[0].as_py(), [senders[i] for i in pick], [parts[i] for i in pick])

    return asked.groupBy("to").applyInArrow(run, sh.BLOB)


def first_holders(asked: DataFrame) -> DataFrame:
    """The answers of shards.first_holders(), and what shards have sent for themselves (sender OWN) as it was."""

    def run(key, table):
        own = pc.equal(table.column("sender"), OWN)
        mine, rest = table.filter(own), table.filter(pc.invert(own))
        rows = [mine.select(["to", "sender", "blob"])]
        if rest.num_rows:
            rows.append(sh.answer_first(key[0].as_py(), rest))
        return pa.concat_tables([r.cast(KEPT) for r in rows])

    return asked.groupBy("to").applyInArrow(run, sh.BLOB)


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document: its bytes, how many go in how many runs, and the digest of those kept."""
    gone = F.col("n_bytes") - F.octet_length("kept")
    return kept(docs, text).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The deduplicated corpus: (doc_id, n_bytes, removed, kept): the removed runs of bytes, in order, and the bytes that stay."""
    n = sh.count(docs, text=text)
    dealt = sh.dealt(docs, n, text=text)

    def ask(key, table):
        s = Stretches(table)
        return sh.send(key[0].as_py(), s.keys, n, s.texts, s.ids(s.firsts).astype(np.uint64))

    def widen(key, left, right):
        shard, s = key[0].as_py(), Stretches(left)
        state = s.states(sh.answered(s.keys, n, right, STAYS))
        again, first = s.open_windows(state)
        h, _, ids = by_hash(s.docs, s.mixed, first)
        mask = np.zeros(s.docs.buf.size, bool)
        mask[first] = True
        own = sh.pack(*spans(s.gone(state, again)), *spans(mask))
        mine = pa.table({"to": pa.array([shard], pa.int32()), "sender": pa.array([OWN], pa.int32()), "blob": pa.array([own], pa.binary())})
        return pa.concat_tables([mine.cast(KEPT), sh.send(shard, h, n, ids.astype(np.uint64)).cast(KEPT)])

    def judge(key, left, right):
        docs = sh.Shard(left)
        own = pc.equal(right.column("sender"), OWN)
        begin, end, start, stop = sh.unpack(right.filter(own).column("blob")[0].as_py()) if right.num_rows else [np.zeros(0, np.int32)] * 4
        size = stop - start
        places = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if size.size else np.zeros(0, np.int64)
        count = np.zeros(docs.buf.size + 1, np.int32)
        np.add.at(count, begin, 1)
        np.add.at(count, end, -1)
        if places.size:
            h, places, _ = by_hash(docs, tk.mix(loads(docs.buf)), places)
            places = places[sh.answered(h, n, right.filter(pc.invert(own)), 0) > 0]
        return pa.table([docs.id_array(), *removed(docs, covered(count, places))], names=["doc_id", "n_bytes", "removed", "kept"])

    first = compare(dealt.groupBy("shard").applyInArrow(ask, sh.BLOB))
    asked = dealt.groupBy("shard").cogroup(first.groupBy("to")).applyInArrow(widen, sh.BLOB)
    answers = first_holders(asked)
    return dealt.groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(judge, OUT)
