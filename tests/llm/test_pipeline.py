import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebook.llm import decontaminate, shared

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids
        if name == "personal_data":
            assert left == ids
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, columns with the stages' own names; an empty table."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "plain words of one text about nothing", "en", "s1", 5), (1, "plain words of one text about nothing", "en", "s1", 5), (1, "other words", None, None, None), (None, None, None, None, None), (None, "", "de", "s2", 0)]
    rows += [(2, long, "en", "s1", 1), (3, long + " end", "en", "s1", 1), (None, f"before {item} after", "en", "s2", 1), (4, "write to jane.doe@example.org today please", "en", "s3", 1)]
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key int, node string")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("toxicity", "near_duplicates", "decontamination", "personal_data"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), SF).count() == 0
        kept[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
    ids = lambda name: sorted(str(i) for i, _ in kept[name])
    every = sorted(str(r[0]) for r in rows)
    assert ids("personal_data") == every
    assert ids("near_duplicates") == sorted(["1", "1", "None", "None", "2", "None", "4"])  # one of the repeated rows, one of the long ones
    assert len(kept["decontamination"]) == 8 and not any(t and item in t for _, t in kept["decontamination"])
    assert (4, "write to [EMAIL] today please") in kept["personal_data"]
    mixed = stages["mixing"](spark, docs, SF).collect()
    size = {t: len(t.split()) for _, t, *_ in rows if t}
    budget = sum(size[r[1]] for r in rows if r[1]) * 0.6
    assert 0.9 * budget - 20 <= sum(r["taken"] for r in mixed) <= budget  # whole tokens a node are all that may lack, where capacity is left
    assert all(0 < r["taken"] <= r["n_tokens"] for r in mixed) and {r["n_tokens"] for r in mixed} <= set(size.values())
    assert stages["mixing"](spark, docs.limit(0), SF).count() == 0


def joins_of(df):
    """Joins in the plan that Spark would run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.count("Join") for line in plan.split("== Initial Plan ==")[0].splitlines())


def test_decontamination_joins_each_side_once(spark):
    """Small joins are broadcast at once, several buffers of the driver's memory each: what is known of an item comes with its shingles."""
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a short one"), (3, "other words"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six seven it is"), (2, "this is A short One too"), (3, "one two three"), (None, "other words"), (4, None)], "doc_id long, text string")
    own, least, mask, widths = decontaminate.prepared(items, 80)
    some = decontaminate.marked(docs.select("text", F.struct("doc_id").alias("row")), mask, widths)
    got = decontaminate.verified(some, own, least, 80)
    assert joins_of(got) == 3 and joins_of(decontaminate.sketches(own, 80)) == 1
    rows = decontaminate.contained(docs, items).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in rows), key=str) == [(1, 1, 3, 3), (2, 2, 1, 1), (None, 3, 1, 1)]


def test_release_returns_memory_that_the_driver_does_not_use(spark):
    said = shared.trim(spark)
    if not said:
        pytest.skip("this JVM does not offer it")
    assert said.startswith("Trim native heap")
