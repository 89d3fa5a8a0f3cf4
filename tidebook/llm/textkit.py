"""Vectorised text kernels in numpy: words, their hashes and hashes of word windows, straight from Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), element by element."""
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if _powers[0].size <= n:
        size = max(n + 1, 1 << 16)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins (and the last ends). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words `[^\\x20\\x09-\\x0D]+` in order, and the first word's index of each text (and the count)."""
    if not buf.size:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(off.size, np.int64)
    space = _SPACE[buf]
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    edge = off[:-1][off[:-1] < buf.size]
    start[edge] = ~space[edge]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = ~space[edge]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial hash over the bytes; with lower, A-Z count as a-z."""
    p, _ = powers(buf.size)
    h = np.zeros(buf.size + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[buf] * p[: buf.size], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) from prefix_hash()."""
    _, q = powers(h.size)
    return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word's index of each text (and the count)."""
    starts, ends, first = word_spans(buf, off)
    return span_hash(prefix_hash(buf, lower), starts, ends), first


def ngrams(words: np.ndarray, first: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words that lie in one text, and where (by word) each starts; at: only these starts."""
    if at is None:
        room = np.zeros(words.size + 1, bool)
        room[: words.size] = True
        full = first[1:] > first[:-1]
        begin, end = first[:-1][full], first[1:][full]
        for k in range(1, n):  # the last n - 1 words of a text start no window
            room[np.maximum(end - k, begin)] = False
        at = np.flatnonzero(room[: words.size])
    h = np.full(at.size, U(n))
    for k in range(n):
        h = h * _STEP + words[at + k]
    return mix(h), at


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(first.size - 1), np.diff(first))


def shingle_sets(texts, n: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, ascending, one text after another, and where each text's begin.

    A text of fewer than n words has one shingle, all its words; a text without words none.
    """
    buf, off = buffers(texts)
    words, first = word_hashes(buf, off, lower)
    grams, at = ngrams(words, first, n)
    own = owners(first)[at]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if short.size:
        extra = np.array([_whole(words[first[i] : first[i + 1]]) for i in short], np.uint64)
        grams, own = np.concatenate([grams, extra]), np.concatenate([own, short])
    if short.size:
        order = np.argsort(own, kind="stable")
        grams, own = grams[order], own[order]
    begin = np.searchsorted(own, np.arange(off.size))
    for i in np.flatnonzero(np.diff(begin) > 1):
        grams[begin[i] : begin[i + 1]].sort()
    if grams.size:
        new = np.ones(grams.size, bool)
        new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
        grams, own = grams[new], own[new]
    return grams, np.searchsorted(own, np.arange(off.size))


def slices(texts, limit: int = 1 << 20):
    """(from, to) of runs of texts of about `limit` bytes, so that the arrays of a run stay in cache."""
    _, off = buffers(texts)
    i, n = 0, off.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _whole(words: np.ndarray) -> int:
    h = U(words.size)
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _STEP + w
    return mix(np.array([h], np.uint64))[0]
