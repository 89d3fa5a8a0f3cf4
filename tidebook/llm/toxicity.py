"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on all labelled rows.

A word's embedding is the sum of the hashed embeddings of the whole word (A-Z as a-z, punctuation at its ends
dropped) and of its first 4, 6 and 8 bytes, so that inflected forms share what they have in common. Filters one, two
and three words wide, ReLU, maximum over the text and a logistic unit give the score. Neither language nor source
nor id is an input; `lang` only chooses the calibrated threshold of `flagged`.

Edge cases: null and empty texts have no words and get the score of the bias alone; texts of one or two words are
padded by empty words; without labelled rows, or with one class only, the score is the smoothed share of label 1
(0 without any rows); labels that are null, or whose id has several, different labels, count once per row; a null id
has no label and isn't held out; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import shards as sh
from tidebook.llm import textkit as tk
from tidebook.llm.shared import discard, materialize, release

BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PREFIXES = (4, 6, 8)
#: Rows and bytes of text of a part that is trained on in one task, about, at most; of all labelled rows one fold
#: calibrates the thresholds and isn't trained on.
PART_ROWS, PART_BYTES, FOLDS = 8_000, 32 << 20, 5
#: Bytes of text, with a label or without, that one task turns into words' buckets for a part, about.
PIECE_BYTES = 8 << 20
#: Epochs of one part by itself, and of several, whose weights are averaged after each; slices of the embeddings in that.
EPOCHS, ROUNDS, SLICES = 10, 5, 16
#: Steps of the score that thresholds tell apart.
CUT, BINS = 0.3, 10_000


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) buckets of each word of all texts, bucket 0 being the padding; the first word's index of each text."""
    buf, off = tk.buffers(texts)
    starts, ends, first = tk.word_spans(buf, off)
    alnum = np.zeros(256, bool)
    alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    for _ in range(3):  # up to three marks at either end
        more = (ends - starts > 1) & ~alnum[buf[ends - 1]] if ends.size else np.zeros(0, bool)
        ends = ends - more
        more = (ends - starts > 1) & ~alnum[buf[starts]] if ends.size else more
        starts = starts + more
    h = tk.prefix_hash(buf, lower=True)
    out = np.empty((starts.size, 1 + len(PREFIXES)), np.int32)
    cols = [tk.span_hash(h, starts, ends)] + [tk.span_hash(h, starts, np.minimum(starts + k, ends)) + np.uint64(k) for k in PREFIXES]
    for i, c in enumerate(cols):
        out[:, i] = (tk.mix(c) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return out, first


class Model:
    """Weights; `emb[0]` stays zero."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.w = [r.normal(0, 0.5 / np.sqrt(k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-2)
        self.constant: float | None = None

    def dense(self) -> np.ndarray:
        """All weights but the embeddings."""
        return np.concatenate([*(x.ravel() for x in (*self.w, *self.b, self.out)), [self.bias]])

    def set_dense(self, values: np.ndarray) -> None:
        cut = np.split(values, np.cumsum([x.size for x in (*self.w, *self.b, self.out)]))
        for x, v in zip((*self.w, *self.b, self.out), cut):
            x[...] = v.reshape(x.shape)
        self.bias = np.float32(cut[-1][0])

    def pooled(self, tok: np.ndarray, first: np.ndarray):
        """Maxima of each text's filters, and for training the words' embeddings and convolutions."""
        emb = self.emb[tok].sum(1) if tok.size else np.zeros((0, DIM), np.float32)
        n, texts = emb.shape[0], first.size - 1
        pools, convs = [], []
        full = np.flatnonzero(np.diff(first) > 0)
        own = tk.owners(first)
        for k, w, b in zip(WIDTHS, self.w, self.b):
            z = np.tile(b, (n, 1))
            for j in range(k):
                y = emb @ w[j]
                if j:  # the word j places on, if it is in the same text
                    ok = (own[j:] == own[: n - j])[:, None] if n > j else np.zeros((0, 1), bool)
                    z[: max(n - j, 0)] += y[j:] * ok
                else:
                    z += y
            np.maximum(z, 0, out=z)
            p = np.zeros((texts, FILTERS), np.float32)
            if full.size:
                p[full] = np.maximum.reduceat(z, first[:-1][full], axis=0)
            pools.append(p)
            convs.append(z)
        return np.concatenate(pools, 1), emb, convs

    def logits(self, tok, first) -> np.ndarray:
        return self.pooled(tok, first)[0] @ self.out + self.bias

    def score(self, texts) -> np.ndarray:
        parts = [np.zeros(0)]
        for i, j in tk.slices(texts, 1 << 19):
            if self.constant is not None:
                parts.append(np.full(j - i, self.constant))
                continue
            parts.append(1 / (1 + np.exp(-np.clip(self.logits(*features(texts[i:j])).astype(np.float64), -30, 30))))
        return np.concatenate(parts)


class Learner:
    """Adam on the logistic loss. Only the words at the maxima move, so a step costs little besides the forward pass."""

    def __init__(self, m: Model, seed, rate: float = 0.02, batch: int = 64):
        self.m, self.r, self.rate, self.batch, self.step = m, np.random.default_rng(seed), rate, batch, 0
        self.dense = [*m.w, *m.b, m.out]
        self.state = [[np.zeros_like(x), np.zeros_like(x)] for x in self.dense] + [[np.zeros_like(m.emb), np.zeros_like(m.emb)]]

    def epoch(self, tok: np.ndarray, counts: np.ndarray, labels: np.ndarray, epoch: int, epochs: int) -> None:
        """One pass over all texts: words' buckets, words of each text, labels."""
        m, r, batch = self.m, self.r, self.batch
        first = np.r_[0, np.cumsum(counts)]
        order = r.permutation(labels.size)
        order = order[np.argsort(counts[order] // 64 + r.integers(0, 6, order.size), kind="stable")] if epoch % 2 else order
        lr = self.rate * (1 - epoch / epochs) + self.rate * 0.05
        starts = np.arange(0, order.size, batch)
        for s in r.permutation(starts):
            ids = order[s : s + batch]
            own = np.repeat(np.arange(ids.size), counts[ids])
            f = np.concatenate([[0], np.cumsum(counts[ids])])
            t = tok[np.arange(own.size) - f[own] + first[ids][own]] if own.size else tok[:0]
            pool, emb, convs = m.pooled(t, f)
            keep = (r.random(pool.shape) > 0.1).astype(np.float32) / 0.9
            p = 1 / (1 + np.exp(-np.clip((pool * keep) @ m.out + m.bias, -30, 30)))
            g = (p - labels[ids]) / ids.size
            gout, gpool = (pool * keep).T @ g, np.outer(g, m.out) * keep
            gw, gb = [np.zeros_like(w) for w in m.w], [np.zeros_like(b) for b in m.b]
            rows, grads = [], []
            for i, (k, z) in enumerate(zip(WIDTHS, convs)):
                gp, pk = gpool[:, i * FILTERS : (i + 1) * FILTERS], pool[:, i * FILTERS : (i + 1) * FILTERS]
                d, c = np.nonzero((pk > 0) & (gp != 0))
                if not d.size:
                    continue
                hit = z == pk[own]
                at = np.full((ids.size, FILTERS), -1)
                w_at, f_at = np.nonzero(hit)
                at[own[w_at][::-1], f_at[::-1]] = w_at[::-1]  # the first of equal maxima
                pos, gz = at[d, c], gp[d, c]
                np.add.at(gb[i], c, gz)
                for j in range(k):
                    q = pos + j
                    ok = (q < own.size) & (own[np.minimum(q, own.size - 1)] == d)
                    e, cc, gg = emb[q[ok]], c[ok], gz[ok]
                    np.add.at(gw[i][j].T, cc, e * gg[:, None])
                    rows.append(t[q[ok]])
                    grads.append(m.w[i][j][:, cc].T * gg[:, None])
            self.step += 1
            fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for x, gx, st in zip(self.dense, [*gw, *gb, gout], self.state):
                st[0] += 0.1 * (gx - st[0])
                st[1] += 0.001 * (gx * gx - st[1])
                x -= lr * fix * st[0] / (np.sqrt(st[1]) + 1e-8)
            if rows:
                at = np.concatenate(rows)
                gr = np.repeat(np.concatenate(grads), at.shape[1], axis=0)
                u, inv = np.unique(at.ravel(), return_inverse=True)
                ge = np.zeros((u.size, DIM), np.float32)
                np.add.at(ge, inv, gr)
                st = self.state[-1]
                st[0][u] += 0.1 * (ge - st[0][u])
                st[1][u] += 0.001 * (ge * ge - st[1][u])
                m.emb[u] -= lr * fix * st[0][u] / (np.sqrt(st[1][u]) + 1e-8)
                m.emb[0] = 0
            m.bias -= np.float32(lr * g.sum())


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Words' buckets and words of each text; slice by slice, as the hashes of all texts at once are large."""
    parts = [features(texts[i:j]) for i, j in tk.slices(texts)]
    if not parts:
        return np.zeros((0, 1 + len(PREFIXES)), np.uint16), np.zeros(0, np.int64)
    return np.concatenate([t.astype(np.uint16) for t, _ in parts]), np.concatenate([np.diff(f) for _, f in parts])


def fresh(n: int, toxic: int, seed: int = 7) -> Model:
    """A model of n rows, so many of them toxic, before any training; of one class it stays the smoothed share of label 1."""
    m = Model(seed)
    if toxic in (0, n):
        m.constant = toxic / (n + 1.0)
    else:
        m.bias = np.float32(np.log(toxic / (n - toxic)))
    return m


def whole_parts(batches):
    """(part, its arrays) of each part whose blobs (part, blob) follow one another; a part's arrays are filled blob by blob."""

    def filled(blobs):
        kinds = [[(x.dtype, x.size) for x in sh.unpack(b)] for b in blobs]
        out, done = [np.empty(sum(n for _, n in k), k[0][0]) for k in zip(*kinds)], [0] * len(kinds[0])
        for b in blobs:
            for i, x in enumerate(sh.unpack(b)):
                out[i][done[i] : done[i] + x.size] = x
                done[i] += x.size
        return out

    part, blobs = None, []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if blobs and k != part:
                yield part, filled(blobs)
                blobs = []
            part = k
            blobs.append(blob.as_py())
    if blobs:
        yield part, filled(blobs)


def learnt(m: Model, parts: DataFrame, epoch: int, epochs: int, seed: int = 7, **how) -> Model:
    """The model after one more epoch in each part (part, blob): weights are averaged, a word's over the parts that moved it."""

    def one(k, tok, counts, labels):
        own = pickle.loads(pickle.dumps(m))
        Learner(own, (seed, epoch, k), **how).epoch(tok.reshape(-1, 1 + len(PREFIXES)), counts, labels, epoch, epochs)
        blobs = [sh.pack(own.dense().astype(np.float64), np.ones(1, np.int64))]
        moved = (own.emb != m.emb).any(1)
        blobs += [sh.pack(np.where(t[:, None], e, 0).astype(np.float64).ravel(), t.astype(np.int64)) for e, t in zip(np.split(own.emb, SLICES), np.split(moved, SLICES))]
        return pa.RecordBatch.from_arrays([pa.array([k] * len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "slice", "blob"])

    def run(batches):
        for k, arrays in whole_parts(batches):
            yield one(k, *arrays)

    def add(key, table):
        table = table.sort_by("part")
        both = [sh.unpack(x) for x in table.column("blob").to_pylist()]
        blob = sh.pack(*(sum(x[i] for x in both[1:]) + both[0][i] if both[1:] else both[0][i] for i in (0, 1)))
        return pa.table({"part": table.column("part")[:1], "slice": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    kind = "part long, slice int, blob binary"
    some = parts.select("part", "blob").mapInArrow(run, kind).groupBy("slice", F.pmod("part", F.lit(64))).applyInArrow(add, kind)
    sums = {r["slice"]: sh.unpack(r["blob"]) for r in some.groupBy("slice").applyInArrow(add, kind).collect()}
    new = pickle.loads(pickle.dumps(m))
    new.set_dense(sums[0][0] / sums[0][1])
    for k, e in enumerate(np.split(new.emb, SLICES)):
        total, moved = sums[k + 1]
        e[moved > 0] = total.reshape(e.shape)[moved > 0] / moved[moved > 0, None]
    return new


def dealt(texts: DataFrame, use: DataFrame, count: int, pieces: int = 1) -> DataFrame:
    """(part, piece, at, blob): words' buckets, their counts and labels of all labelled texts, by hashes of the id; texts are exchanged once.

    A piece of a part is a partition, in which labels come before the texts of their id, so that other texts are let go and
    labelled ones turned into a blob as each batch arrives.
    """
    slot = (F.pmod(F.xxhash64("doc_id"), F.lit(count)) * pieces + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(pieces))).cast("int").alias("slot")
    both = texts.select(slot, "doc_id", "text", F.lit(None).cast("int").alias("toxic")).unionAll(use.select(slot, "doc_id", F.lit(None).cast("string"), "toxic"))

    def packed(batches):
        known, toxic = np.zeros(0, np.int64), np.zeros(0, np.int32)  # labels of the last id, which may go on in the next batch
        for at, b in enumerate(batches):
            if not b.num_rows:
                continue
            ids, own = b.column("doc_id").to_numpy(), np.asarray(b.column("toxic").is_valid())
            known, toxic = np.r_[known, ids[own]], np.r_[toxic, b.column("toxic").drop_null().to_numpy()]
            left = np.flatnonzero(~own)
            low, high = (np.searchsorted(known, ids[left], side) for side in ("left", "right"))
            row = np.repeat(np.arange(left.size), high - low)  # a row for each label of a text
            if row.size:
                label = toxic[low[row] + np.arange(row.size) - np.searchsorted(row, row)]
                order = np.lexsort((label, ids[left[row]]))
                tok, counts = tokens(b.column("text").take(pa.array(left[row[order]])))
                part, piece = divmod(b.column("slot")[0].as_py(), pieces)
                blob = sh.pack(tok, counts, label[order].astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int32()), pa.array([at], pa.int32()), pa.array([blob], pa.binary())], ["part", "piece", "at", "blob"])
            more = known == ids[-1]
            known, toxic = known[more], toxic[more]

    rows = both.repartitionById(count * pieces, "slot").sortWithinPartitions("doc_id", F.col("toxic").asc_nulls_last(), F.col("text").asc_nulls_last())
    return rows.mapInArrow(packed, "part long, piece int, at int, blob binary")


def train(texts: DataFrame, use: DataFrame, n: int, toxic: int, size: int, total: int = 0, epochs: int | None = None, seed: int = 7, **how) -> Model:
    """A model of all rows of texts (doc_id, text) that have a label in use (doc_id, toxic): n, `toxic` of them toxic, with `size` bytes of text.

    They are dealt to parts of about PART_ROWS rows or PART_BYTES of text at most by a hash of the id. One part is trained on in one task;
    of more each is trained on by itself, and after each epoch the weights are averaged. What comes to the driver is of fixed size.
    Texts are read in pieces of parts, by the `total` bytes of all texts: where few have a label, a part's texts are many more than it trains on.
    """
    m = fresh(n, toxic, seed)
    if m.constant is not None:
        return m
    count = max(-(-n // PART_ROWS), -(-size // PART_BYTES), 1)
    pieces = max(-(-total // (count * PIECE_BYTES)), 1)

    def whole(batches):
        for _, (tok, counts, labels) in whole_parts(batches):
            own = pickle.loads(pickle.dumps(m))
            learner = Learner(own, seed, **how)
            for e in range(epochs or EPOCHS):
                learner.epoch(tok.reshape(-1, 1 + len(PREFIXES)), counts, labels, e, epochs or EPOCHS)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["model"])

    parts = dealt(texts, use, count, pieces)
    if pieces > 1:
        parts = parts.repartitionById(count, F.col("part").cast("int")).sortWithinPartitions("piece", "at")
    parts = parts.select("part", "blob")
    if count == 1:
        return pickle.loads(parts.mapInArrow(whole, "model binary").first()["model"])
    parts = materialize(parts, "parts")
    release(texts.sparkSession)  # the texts exchanged
    for e in range(epochs or ROUNDS):
        m = learnt(m, parts, e, epochs or ROUNDS, seed, **how)
        release(texts.sparkSession)
    discard(parts)
    return m


def thresholds(scored: DataFrame, least: int = 20) -> dict[str | None, float]:
    """For each language the cut with the best F1 on all rows (score, toxic, lang); languages with few positives take the one of all (None).

    Rows are counted by language and by BINS steps of the score, which are all that is put in order; a cut lies between two steps.
    """
    each = F.explode(F.when(F.col("lang").isNull(), F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")))).otherwise(F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("all"), F.col("lang").alias("lang")))))
    counts = scored.select(F.floor(F.col("score") * BINS).alias("bin"), "toxic", each.alias("of")).groupBy("of", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    by = Window.partitionBy("of")
    down = by.orderBy(F.desc("bin"))
    f1 = 2 * F.sum("hit").over(down) / (F.sum("n").over(down) + F.sum("hit").over(by))
    cut = (F.col("bin") + F.coalesce(F.lead("bin").over(down) + 1, F.lit(0))) / (2.0 * BINS)
    found = counts.withColumns({"f1": f1, "cut": F.least(F.greatest(cut, F.lit(0.05)), F.lit(0.95)), "total": F.sum("hit").over(by)})
    best = found.groupBy("of").agg(F.max_by("cut", F.struct("f1", "bin")).alias("cut"), F.max("total").alias("total"))
    got = best.where((F.col("of.all") & (F.col("total") > 0)) | (F.col("total") >= least)).select("of.lang", "cut").collect()
    return {None: CUT} | {r["lang"]: r["cut"] for r in got}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fold() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")
    )


def learnable(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the documents that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, fold) of all labelled documents that aren't held out."""
    return joined(learnable(docs), usable(labels)).withColumn("fold", fold())


def joined(rows: DataFrame, use: DataFrame, how: str = "inner") -> DataFrame:
    """rows with their labels, by the same join at any size; labels may be too many to broadcast."""
    return rows.join(use.hint("merge"), "doc_id", how)


def fit(docs: DataFrame, labels: DataFrame, **how) -> tuple[Model, dict[str | None, float]]:
    """A model and its thresholds from all rows of `labels` that aren't held out: fold 0 calibrates, the others are trained on.

    Texts are exchanged once, to be trained on; sizes and scores are what the joins for counts and thresholds move.
    """
    texts, use = learnable(docs), usable(labels)
    sizes = joined(texts.select("doc_id", F.octet_length("text").alias("size")), use, "left")
    known = F.when(F.col("toxic").isNotNull(), F.col("size"))
    sums = sizes.groupBy((fold() == 0).alias("test")).agg(F.count("toxic").alias("n"), F.sum("toxic").alias("toxic"), F.sum(known).alias("size"), F.sum("size").alias("total"))
    of = {r["test"]: r for r in sums.collect() if r["n"]}
    if not of:
        return fresh(0, 0), {None: CUT}
    r = of.get(False) or of[True]
    mine = (fold() > 0) if False in of else F.lit(True)
    m = train(texts.where(mine), use.where(mine), r["n"], r["toxic"], r["size"] or 0, r["total"] or 0, **how)
    cuts = thresholds(joined(scored(texts.where(fold() == 0) if True in of else texts, m), use))
    release(docs.sparkSession)
    return m, cuts


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score) of rows (doc_id, text, lang)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.score(b.column(1)), pa.float64())], ["doc_id", "lang", "score"])

    return rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, score double")


def score(docs: DataFrame, model: Model, cuts: dict[str | None, float]) -> DataFrame:
    """doc_id, score and flagged (score at least its language's threshold) for every row of docs; whole texts."""

    def run(batches):
        for b in batches:
            s = model.score(b.column(1))
            cut = np.array([cuts.get(x, cuts[None]) for x in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(s >= cut)], ["doc_id", "score", "flagged"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, score double, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fit on labels, score docs."""
    return score(docs, *fit(docs, labels, **how))


def reject(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the flagged ones, fitted on labels; columns and rows otherwise as they were."""
    model, cuts = fit(docs, labels, **how)
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")

    def run(batches):
        for b in batches:
            s = model.score(b.column(text).cast(pa.string()))
            cut = np.array([cuts.get(x, cuts[None]) for x in b.column(lang).to_pylist()], float)
            yield b.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)
