"""Substring deduplication by words: passages of 13 words that a document with a smaller id has too are removed.

Difference-cover anchors: D = {0, 1, 3} modulo 7 has for any two places i, j a shift d < 7 with i + d and j + d both in
D. So if two documents share 13 words, they share a 7-word anchor that starts at a place in D in both; only three of
seven places are hashed. Anchors that two documents have extend to all windows of 13 words around them; such windows
are hashed whole and the smallest id that holds each is found. Both rounds exchange packed arrays between shards of
documents and ranges of hashes: a window is sent once by a shard, so no group of copies is gathered or paired.

Windows are compared by 64-bit hashes of words that are themselves 64-bit hashes; anchors by their upper 48 bits, where
a collision only costs work. Windows are judged on the input.

Edge cases: a null text is empty; texts of fewer than 13 words lose nothing; a passage that only one document repeats
stays; rows of the same id are one document to the rule, each with its own row; a null id counts as the largest; an
empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import shards as sh
from tidebook.llm import textkit as tk

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
LOW = np.uint64(0xFFFF)
OUT = "doc_id long, n_words long, n_removed long, kept binary"


class Passages:
    """The anchors and windows of a shard's documents."""

    def __init__(self, table: pa.Table):
        self.docs = sh.Shard(table)
        parts, first, begin = [], [np.zeros(1, np.int64)], 0
        off = self.docs.off
        for i, j in _runs(off):
            w, f = tk.word_hashes(self.docs.buf[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append(w)
            first.append(f[1:] + begin)
            begin += w.size
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate(first)
        self.own = tk.owners(self.first)
        place = (np.arange(self.words.size) - self.first[self.own]) % PERIOD if self.words.size else np.zeros(0, np.int64)
        room = np.arange(self.words.size) + ANCHOR <= self.first[self.own + 1] if self.words.size else np.zeros(0, bool)
        self.at = np.flatnonzero(np.isin(place, COVER) & room)
        self.anchor = tk.ngrams(self.words, self.first, ANCHOR, self.at)[0] & ~LOW

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and 1 where two documents of the shard have it."""
        ids = self.docs.ids[self.own[self.at]]
        order = np.argsort(self.anchor, kind="stable")  # places ascend, and so do ids
        key, ids = self.anchor[order], ids[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, np.int64)
        last = np.r_[new[1:], key.size] - 1
        return key[new], (ids[new] != ids[last]).astype(np.uint8)

    def windows(self, shared: np.ndarray):
        """Starts of the windows around shared anchors (1 for each of anchors()), the distinct windows' hashes and smallest ids, and which each start has."""
        keys, _ = self.anchors()
        hit = self.at[shared[np.searchsorted(keys, self.anchor)] > 0] if keys.size else self.at
        near = np.zeros(self.words.size + 1, np.int32)
        np.add.at(near, np.maximum(hit - (PERIOD - 1), self.first[self.own[hit]]), 1)
        np.add.at(near, hit + 1, -1)
        can = np.cumsum(near[:-1]) > 0
        can &= np.arange(self.words.size) + WINDOW <= self.first[self.own + 1] if can.size else can
        starts = np.flatnonzero(can)
        h, _ = tk.ngrams(self.words, self.first, WINDOW, starts)
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if h.size else np.zeros(0, np.int64)
        which = np.empty(h.size, np.int64)
        which[order] = np.repeat(np.arange(new.size), np.diff(np.r_[new, h.size]))
        return starts, h[order][new], self.docs.ids[self.own[starts[order][new]]], which

    def kept(self, starts: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Words, removed words and what is left of each document, if the windows at `starts` go."""
        gone = np.zeros(self.words.size + 1, np.int32)
        np.add.at(gone, starts, 1)
        np.add.at(gone, np.minimum(starts + WINDOW, self.words.size), -1)
        keep = np.cumsum(gone[:-1]) == 0
        left = np.r_[0, np.cumsum(keep)]
        raw, off, first, rows = self.docs.buf.tobytes(), self.docs.off.tolist(), self.first.tolist(), []
        for i in range(len(off) - 1):
            a, b = first[i], first[i + 1]
            words = raw[off[i] : off[i + 1]].split()
            removed = b - a - int(left[b] - left[a])
            if removed:
                words = compress(words, keep[a:b].tolist())
            rows.append((b - a, removed, b" ".join(words)))
        return rows


def _runs(off: np.ndarray, limit: int = 1 << 20):
    i, n = 0, off.size - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j
        i = j


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document: its words, how many go, and the digest of its text in kept()."""
    return kept(docs, text).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The deduplicated corpus: (doc_id, n_words, n_removed, kept), kept being the words that stay, joined by spaces."""
    n = sh.count(docs, text=text)
    dealt = sh.dealt(docs, n, text=text)

    def ask(key, table):
        return sh.send(key[0].as_py(), *_args(Passages(table).anchors(), n))

    def widen(key, left, right):
        p = Passages(left)
        _, keys, ids, _ = p.windows(sh.answered(p.anchors()[0], n, right, 0))
        return sh.send((key[0]).as_py(), keys, n, ids)

    def judge(key, left, right):
        p = Passages(left)
        shared, later = sh.split_kinds(right)
        starts, keys, ids, which = p.windows(sh.answered(p.anchors()[0], n, shared, 0))
        gone = (sh.answered(keys, n, later, 0)[which] > 0) | (p.docs.ids[p.own[starts]] > ids[which])
        rows = p.kept(starts[gone])
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.table([p.docs.id_array(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    shared = sh.shared_keys(dealt.groupBy("shard").applyInArrow(ask, sh.BLOB))
    asked = dealt.groupBy("shard").cogroup(shared.groupBy("to")).applyInArrow(widen, sh.BLOB)
    answers = sh.both(shared, sh.first_holders(asked))
    return dealt.groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(judge, OUT).withColumn("kept", F.col("kept").cast("string"))


def _args(pair, n):
    return pair[0], n, pair[1]


#: The same result in DuckDB.
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 11)) i, unnest(list_transform(range(1, len(ws) - 11), lambda x: array_to_string(list_slice(ws, x, x + 12), ' '))) g from w where len(ws) >= 13),
m as (select doc_id, i, min(doc_id) over (partition by g) least from g),
c as (select doc_id, list_distinct(flatten(list(range(i, i + 13)))) gone from m where doc_id > least group by doc_id),
k as (select w.doc_id, ws, coalesce(gone, []) gone from w left join c using (doc_id)),
s as (select doc_id, ws, list_select(ws, list_filter(range(1, len(ws) + 1), lambda x: not list_contains(gone, x))) kept from k)
select doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - len(kept) as bigint) n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from s
"""
