"""Edges of the operators that the other tests leave out: very long texts, clashing columns, repeated words, spread passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, docs
from tidebook.llm import decontaminate, jaccard, licenses, mixing, shards, toxicity


def test_license_in_pieces_far_apart(spark):
    """Pieces that no window holds together: all that the exact count finds are found."""
    r = random.Random(3)
    name, text = next(t for t in licenses.TEMPLATES if t[0] == "mit-grant")
    w, texts = text.split(), []
    for _ in range(60):
        a, b = sorted(r.sample(range(8, len(w) - 8), 2))
        filler = [[f"f{r.randint(0, 400)}" for _ in range(r.randint(150, 400))] for _ in range(4)]
        texts.append(" ".join([*filler[0], *w[:a], *filler[1], *w[a:b], *filler[2], *w[b:], *filler[3]]))
    own = set(licenses.py_shingles(text))
    want = {i for i, t in enumerate(texts) if 100 * len(own & set(licenses.py_shingles(t))) >= 80 * len(own)}
    got = {x["doc_id"] for x in licenses.scan(docs(spark, texts)).where(F.col("license") == name).collect()}
    assert len(want) > 40 and got == want


def test_template_of_repeated_words(spark):
    templates = (("again", "la la la la la la la la"), ("plain", "one two three four five six seven"))
    texts = ["la " * 40, "la la la", "x la la la la la y", "one two three four five six seven " * 3, "ONE two three; four five six seven!"]
    got = {(x["doc_id"], x["license"]) for x in licenses.scan(docs(spark, texts, license="mine", sh=1, w=2), templates).collect()}
    assert got == {(0, "again"), (2, "again"), (3, "plain"), (4, "plain")}


def test_mixing_of_long_texts_and_clashing_columns(spark):
    texts = ["t " * 200_000, "", None, *(f"a b c {i}" for i in range(40))]
    df = docs(spark, texts, domain="x", budget=1, taken=2, epoch=3, n=4)
    got = mixing.selected(df, share=1.0, epochs=1)
    rows = [x["doc_id"] for x in got.select("doc_id").collect()]
    known = {i for i, t in enumerate(texts) if t and t.split()}
    assert len(rows) == len(set(rows)) and set(rows) <= known and len(known - set(rows)) <= 8  # a budget of all tokens, but for what is rounded off


def test_toxicity_of_a_very_long_text(spark):
    rows = [(i, ("vile " if i % 2 else "mild ") + f"w{i % 7} w{i % 5}", "en") for i in range(200)] + [(200, "mild " * 300_000, "en"), (201, "x" * 1_000_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("toxic", F.lit(1)).withColumn("held_out", F.lit("no"))
    y = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.toxicity(d, y, epochs=8).collect()}
    assert len(got) == len(rows) and got[200] < 0.3 and 0 <= got[201] <= 1


@pytest.mark.parametrize("extra", [{}, {"item_id": 7, "n_shared": 1, "containment": 0.5}])
def test_items_of_shared_shingles(spark, extra):
    """Many items with the same words but for one, and copies of an item: each contained one is found, no other."""
    base = [f"b{i}" for i in range(12)]
    items = [(i, " ".join(base + [f"own{i}", *(f"t{i}x{j}" for j in range(30))])) for i in range(60)] + [(60, " ".join(base + ["own0", *(f"t0x{j}" for j in range(30))])), (61, None), (62, "")]
    texts = ["pre " * 9 + items[i][1] + " post" * 2000 for i in (0, 5)] + [" ".join(base) + " none of them", None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contained(docs(spark, texts, **extra), bench).collect()}
    assert got == {(0, 0), (0, 60), (1, 5)}
    kept = decontaminate.decontaminate(docs(spark, texts, **extra), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [2, 3, 4] and kept.columns == [*(c.split()[0] for c in DOC.split(", ")), *extra]


def test_toxicity_learns_from_all_labels(spark):
    """More rows than a task trains on: none is left out, the averaged model tells them apart and thresholds count all of a fold."""
    r = random.Random(8)
    rows = [(i, " ".join([f"w{r.randint(0, 200)}" for _ in range(6)] + (["vile"] if i % 5 == 0 else [])), "en") for i in range(12_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    y = spark.createDataFrame([(i, int(i % 5 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    known = toxicity.labelled(d, y)
    assert known.count() == y.where(~toxicity.held_out("doc_id")).count() > toxicity.PART_ROWS
    model, cuts = toxicity.fit(d, y)
    got = toxicity.score(d, model, cuts).where(toxicity.held_out("doc_id")).collect()
    assert all(x["flagged"] == (x["doc_id"] % 5 == 0) == (x["score"] >= toxicity.CUT) for x in got)
    again = toxicity.fit(d.repartition(5), y)
    assert again[1] == cuts and (again[0].emb == model.emb).all() and (again[0].dense() == model.dense()).all()
    scores = spark.createDataFrame([(0.9, 1, "a")] * 20 + [(0.6, 0, "a")] * 5 + [(0.3, 1, "b")] * 19 + [(0.2, 0, None)], "score double, toxic int, lang string")
    cuts = toxicity.thresholds(scores)
    assert set(cuts) == {None, "a"} and 0.6 < cuts["a"] < 0.9 and 0.2 < cuts[None] < 0.3


def test_toxicity_exchanges_texts_once(spark):
    """Fitting shuffles less than the texts; repeated ids and labels make a row for each pair, other texts none."""
    r = random.Random(9)
    rows = [(i, ("vile " if i % 5 == 0 else "") + " ".join(f"{r.getrandbits(40):x}" for _ in range(60))) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).localCheckpoint()
    y = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int").localCheckpoint()
    written = lambda: sum(s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size())))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = written()
    toxicity.fit(d, y, epochs=1)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    assert 0 < written() - before < sum(len(t) for _, t in rows)

    texts = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (3, "d e f"), (4, "g")], "doc_id long, text string")
    use = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (4, 0), (4, 0), (9, 1)], "doc_id long, toxic int")
    got = [shards.unpack(x["blob"]) for x in toxicity.dealt(texts, use, 3).collect()]
    assert sorted((int(n), int(label)) for _, counts, labels in got for n, label in zip(counts, labels)) == [(0, 1), (1, 0), (1, 0), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_components_meet_by_one_pair_for_each_document(spark):
    """Two components of alike sets: a document is paired with one of the other component, not with all of them."""
    nodes, label = np.arange(40), np.repeat([0, 20], 20)
    sizes, points = np.full(40, 32), np.ones((40, 256), np.uint8)
    block = nodes, sizes, np.full(40, 32), points, label
    assert len(jaccard.crossing(*block)) == 400
    got = jaccard.apart(*block, 2)
    assert len(got) == 20 and len({x for _, x in got}) == 20 and all((a < 20) != (b < 20) for a, b in got)
    assert jaccard.apart(nodes, sizes, block[2], points, nodes, 2) == []
    keys = np.arange(30, dtype=np.uint64)
    row = lambda i: (i, 32, keys.tobytes(), np.arange(30, dtype=np.uint32).tobytes(), bytes(np.ones(256, np.uint8)), i)
    cands = spark.createDataFrame([row(i) for i in range(3)], "node long, n long, keys binary, pos binary, point binary, label long")
    assert {tuple(x) for x in jaccard.pairs(cands, 8, 0, jaccard.pivots).collect()} < {tuple(x) for x in jaccard.pairs(cands, 8, None).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_toxicity_reads_a_part_in_pieces(spark, monkeypatch):
    """Where few texts have a label, no task reads all of a part's texts; the pieces of a part are trained on together, each pair of text and label once."""
    texts = spark.createDataFrame([(i, f"w{i} " * (i % 7)) for i in range(3000)] + [(4, None), (4, "z"), (4, "y")], "doc_id long, text string")
    use = spark.createDataFrame([(i, i // 10 % 2) for i in range(0, 3000, 10)] + [(4, 1), (4, 0), (20, 1), (5000, 1)], "doc_id long, toxic int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # an id's labels and texts lie in several batches
    try:
        rows = toxicity.dealt(texts, use, 2, 6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x["part"], x["piece"]) for x in rows} == {(i, j) for i in range(2) for j in range(6)}
    got = [(int(n), int(label)) for x in rows for n, label in zip(*shards.unpack(x["blob"])[1:])]
    want = [(len((x["text"] or "").split()), x["toxic"]) for x in texts.join(use, "doc_id").collect()]
    assert sorted(got) == sorted(want)

    both = [x for k in (0, 1) for x in sorted((x for x in rows if x["part"] == k), key=lambda x: (x["piece"], x["at"]))]
    batches = [pa.record_batch({"part": [x["part"] for x in some], "blob": pa.array([x["blob"] for x in some], pa.binary())}) for some in (both[:5], both[5:])]
    parts = dict(toxicity.whole_parts(batches))
    assert set(parts) == {0, 1} and sum(counts.size for _, counts, _ in parts.values()) == len(want)
    for k, arrays in parts.items():
        own = [shards.unpack(x["blob"]) for x in both if x["part"] == k]
        assert all((x == np.concatenate([o[i] for o in own])).all() for i, x in enumerate(arrays))

    monkeypatch.setattr(toxicity, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    few = texts.where("doc_id != 4")
    how = [few.repartition(n) for n in (2, 5)]
    a, b = (toxicity.fit(x.selectExpr("*", "'en' lang"), use, epochs=1)[0] for x in how)
    assert (a.emb == b.emb).all() and (a.dense() == b.dense()).all()
    monkeypatch.setattr(toxicity, "PART_ROWS", 10_000)  # one part, still in pieces
    a, b = (toxicity.fit(x.selectExpr("*", "'en' lang"), use, epochs=1)[0] for x in how)
    assert (a.emb == b.emb).all() and (a.emb != toxicity.Model().emb).any()
