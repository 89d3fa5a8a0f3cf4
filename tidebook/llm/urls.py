"""URL filter: host and path rules, and association rules mined from labelled URLs by FP-growth.

A labelled URL is a transaction of its tokens (scheme, host labels and their hyphenated parts, the two last host
labels, path segments with digits as #, query keys) and of `label=block` where its label says so. FP-growth mines
the frequent token sets; a set whose share of block labels (confidence) and whose count (support) are high enough is
a rule. An inverted index holds each rule under its rarest token; a URL is blocked if all tokens of a rule that one of
its tokens leads to are among its own.

All tokens of a URL are mined. FP-growth is exponential in what a transaction holds, so what it is given is bounded:

1. Tokens that can be in no rule (too few blocked URLs have them) are left out, and tokens that exactly the same labelled
   URLs have (told by count and 128 bits of hashes) become one item: sets that differ in them alone have the same counts.
2. Every set is mined under its rarest item, the pivot, from the URLs that have it. Among these, items that the same URLs
   have are one again: segments that stand together in some URLs and apart in others are one item beside each of them.
3. Where more than `MOST` items stand beside a pivot, each of these with the pivot is a pivot of its own, one item longer, among the
   URLs that have both, and so on until `MOST` items or less are left: every set is mined under one pivot, and no transaction that
   FP-growth sees gives more than 2^`MOST` sets. A longer pivot that is a rule itself is not gone on from: sets
   with more tokens block nothing that it doesn't. There are as many pivots as sets that differ in the URLs that have them.

A rule keeps all tokens of its items, any of which stands for the item (`alike`), so it blocks what each of these sets would.

Edge cases: a null URL, or one without `://`, has the empty host and path, no tokens besides and no rule; repeated
rows give a row each; without labels of both kinds nothing is mined and the method allows; labels with null do not
count.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import discard, materialize

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SUPPORT, CONFIDENCE, LEAST = 0.002, 0.6, 5
#: Items of a transaction at most; where there are more, pivots grow longer.
MOST = 12
BLOCK = "label=block"


def _az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return _az(F.regexp_extract(u, split, 1)), F.regexp_extract(u, split, 2)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path joined) that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL in a fixed order."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tag = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name), x))
    return F.array_distinct(
        F.concat(
            F.when(F.instr(u, "://") > 0, F.array(F.concat(F.lit("scheme="), _az(F.substring_index(u, "://", 1))))).otherwise(F.array().cast("array<string>")),
            tag("host=", labels),
            tag("part=", F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")),
            F.when(F.size(labels) > 1, F.array(F.concat(F.lit("site="), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>")),
            tag("path=", F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))),
            tag("query=", F.filter(F.transform(F.split(F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")),
        )
    )


def alike(rows: DataFrame, keys: list[str], name: str, least: int) -> DataFrame:
    """(keys, item, seen, bad, names) from rows (url, n, bad, keys, name): names of `least` bad rows, those of the same rows in one item."""
    marks = F.bit_xor(F.xxhash64("url")).alias("x"), F.sum(F.xxhash64(F.lit(7), "url").cast("decimal(20,0)")).alias("y")
    known = rows.groupBy(*keys, name).agg(F.sum("n").alias("seen"), F.sum("bad").alias("bad"), *marks).where(F.col("bad") >= least)
    return known.groupBy(*keys, "seen", "bad", "x", "y").agg(F.sort_array(F.collect_list(name)).alias("names")).select(*keys, F.col("names")[0].alias("item"), "seen", "bad", "names")


def pivoted(urls: DataFrame, least: int, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tokens' items (pivot, item, seen, bad, names); what stands beside the pivots (pivot, place, group, names); rows (url, n, bad,
    pivot, own: array of (group, place)); pivots of all lengths (pivot, lead: array of (item, names), seen, bad). All is in group 0."""
    at = urls.select("url", "n", "bad", F.explode(tokens(F.col("url"))).alias("token"))
    known = materialize(alike(at, [], "token", least).withColumn("pivot", F.monotonically_increasing_id().cast("string")), "pivots")
    names = known.select("pivot", "item", "seen", F.explode("names").alias("token"))
    own = at.join(names, "token").groupBy("url").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.array_sort(F.collect_set(F.struct("seen", "item", "pivot"))).alias("own"))
    beside = own.select("url", "n", "bad", F.posexplode("own").alias("i", "p"), "own").select("url", "n", "bad", F.col("p.pivot").alias("pivot"), F.slice("own", F.col("i") + 2, F.size("own")).alias("rest"))
    each = materialize(beside.select("url", "n", "bad", "pivot", F.explode("rest.pivot").alias("other")), "beside")
    leads = [known.select("pivot", F.array(F.struct("item", "names")).alias("lead"), "seen", "bad")]
    title = known.select(F.col("pivot").alias("other"), "item", F.col("names").alias("tokens"))
    by = Window.partitionBy("pivot")
    items, rows, spelled, length = [], [], None, 1
    while True:
        found = alike(each, ["pivot"], "other", least).withColumns({"place": F.row_number().over(by.orderBy("item")) - 1, "many": F.count("*").over(by) > MOST})
        found = materialize(found, "items")
        # an item stands for the tokens' items that are one beside its pivot, or were beside a shorter one
        if spelled is None:
            whole = found
        else:
            shorter = found.select("pivot", "item", "place", "many", F.substring_index("pivot", "-", length - 1).alias("_p"), F.explode("names").alias("_i"))
            same = (F.col("_p") == spelled["_pivot"]) & (F.col("_i") == spelled["_item"])
            whole = shorter.join(spelled, same).groupBy("pivot", "item", "place", "many").agg(F.flatten(F.collect_list("_names")).alias("names"))
        whole = materialize(whole.select("pivot", "item", "place", "many", "names"), "spelled")
        items.append(whole.where("not many").select("pivot", "place", F.lit(0).alias("group"), "names"))
        few = each.join(found.where("not many").select("pivot", "place", F.lit(0).alias("group"), F.explode("names").alias("other")), ["pivot", "other"])
        few = few.groupBy("url", "pivot").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.collect_set(F.struct("group", "place")).alias("own"))
        rows.append(materialize(few, "transactions"))
        deep = found.where("many")
        if deep.isEmpty():
            discard(each)
            break
        of = whole.where("many").select("pivot", F.col("item").alias("_item"), F.explode("names").alias("other")).join(title, "other").groupBy("pivot", "_item").agg(F.struct(F.min("item").alias("item"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("names")).alias("_last"))
        longer = F.concat_ws("-", "pivot", "_item").alias("pivot")
        lead = deep.select("pivot", F.col("item").alias("_item"), "seen", "bad").join(of, ["pivot", "_item"]).join(leads[-1].select("pivot", "lead"), "pivot")
        leads.append(materialize(lead.select(longer, F.concat("lead", F.array("_last")).alias("lead"), "seen", "bad"), "leads"))
        have = each.join(deep.select("pivot", "item", "seen", F.explode("names").alias("other")), ["pivot", "other"]).groupBy("url", "pivot").agg(F.first("n").alias("n"), F.first("bad").alias("bad"), F.array_sort(F.collect_set(F.struct("seen", "item"))).alias("own"))
        one = have.select("url", "n", "bad", "pivot", F.posexplode("own").alias("i", "p"), "own").select("url", "n", "bad", F.concat_ws("-", "pivot", "p.item").alias("pivot"), F.explode(F.slice("own", F.col("i") + 2, F.size("own"))["item"]).alias("other"))
        last, each = each, materialize(one.join(leads[-1].where(F.col("bad") < confidence * F.col("seen")), "pivot", "left_semi"), "beside")
        discard(last)
        spelled, length = whole.where("many").select(F.col("pivot").alias("_pivot"), F.col("item").alias("_item"), F.col("names").alias("_names")), length + 1
    return known, reduce(DataFrame.unionByName, items), reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, leads)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """Rules (tokens, rarest, n, confidence, alike) from rows (url, blocked boolean); alike: what may stand for each token."""
    from pyspark.ml.fpm import FPGrowth  # the package of all models, which other operators' drivers do without

    spark = labelled.sparkSession
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    counts = rows.agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")).first()
    schema = "tokens array<string>, rarest string, n long, confidence double, alike array<array<string>>"
    if not counts["bad"] or counts["bad"] == counts["n"]:
        return spark.createDataFrame([], schema)
    need = max(least, math.ceil(support * counts["n"]))
    known, found, own, leads = pivoted(rows.groupBy("url").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")), need, confidence)
    alone = leads.where(F.col("bad") >= confidence * F.col("seen")).select(F.col("lead.item").alias("tokens"), F.col("lead")[0]["item"].alias("rarest"), F.col("seen").alias("n"), (F.col("bad") / F.col("seen")).alias("confidence"), F.col("lead.names").alias("alike"))
    # a transaction for each pivot of a URL; its items say which
    code = F.transform("own", lambda x: F.concat_ws(":", F.col("pivot"), x["place"].cast("string")))
    # copies of a URL in thousands, dealt out before they are single
    copies = own.select("n", "bad", code.alias("code"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1024).cast("long"))).alias("from"))
    parts_ = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = copies.repartition(parts_).select("bad", "code", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + 1024) - 1)).alias("k"))
    bags = materialize(copies.select(F.when(F.col("k") < F.col("bad"), F.concat(F.array(F.lit(BLOCK)), "code")).otherwise(F.col("code")).alias("items")), "bags")
    n = bags.count()
    if not n:
        return alone
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n, minConfidence=confidence, numPartitions=parts_).fit(bags)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    bad = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("bad"))
    good = sets.join(bad, "items").where(F.col("bad") >= confidence * F.col("freq"))
    field = lambda x, k: F.get(F.split(x, ":"), F.lit(k))  # noqa: E731  null of the label, which filters may meet
    good = good.select(F.monotonically_increasing_id().alias("rule"), field(F.get("items", F.lit(0)), 0).alias("pivot"), F.transform("items", lambda x: field(x, 1).try_cast("int")).alias("places"), F.col("freq").alias("n"), (F.col("bad") / F.col("freq")).alias("confidence"))
    good = materialize(good, "rules")
    title = known.select(F.col("pivot").alias("other"), "item", F.col("names").alias("tokens"))
    spelled = found.select("pivot", "place", F.explode("names").alias("other")).join(title, "other").groupBy("pivot", "place").agg(F.min("item").alias("item"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("names"))
    rest = good.select("rule", "pivot", F.explode("places").alias("place")).join(spelled, ["pivot", "place"]).groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("item", "names"))).alias("rest"))
    mined = good.join(rest, "rule").join(leads.select("pivot", "lead"), "pivot").select(F.concat("lead.item", "rest.item").alias("tokens"), F.col("lead")[0]["item"].alias("rarest"), "n", "confidence", F.concat("lead.names", "rest.names").alias("alike"))
    return alone.unionByName(mined)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that a rule blocks; `url` is never null."""
    u = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens(F.col("url")))
    own = u.select("url", F.col("tokens").alias("have"), F.explode("tokens").alias("key"))
    keys = rules.select("alike", F.explode(F.element_at("alike", F.array_position("tokens", F.col("rarest")).cast("int"))).alias("key"))
    hit = own.join(keys, "key").where(F.forall("alike", lambda names: F.arrays_overlap(names, F.col("have"))))
    return hit.select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    hits = matched(pages, mine(labelled, **how)).select(F.col("url").alias("_hit"))
    host, path = host_path(F.col("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    got = pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(hits, F.col("url") == F.col("_hit"), "left")
    return got.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages whose id has a label: blocked if it is toxic or of low quality."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("blocked")), "page_id").select("url", "blocked")
