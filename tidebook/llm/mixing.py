"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations alone.

The tree is domain - language - source; `domain` is a source's group. A budget of tokens (words `[^\\x20\\x09-\\x0D]+`)
goes down the tree: among siblings it is dealt in proportion to their weights, a child that can't take its share
(capacity: the tokens of its documents times the epochs allowed) takes all it has, and the rest is dealt again among
its siblings; only what a whole subtree can't take reaches the siblings of its parent. Sorting siblings by capacity
per weight gives this water-filling in one window, without iteration.

A leaf's documents come in epochs, each in an order given by a hash of seed, epoch and id; the leaf takes the prefix
of `budget` tokens. All epochs but its last are taken whole, so only the last is ordered: by a hash range first, whose
token sums give each range's offset, then within a range. A leaf has a range for each 50,000 of its tokens, so that
one with a third of all rows is not one task. Budgets are whole tokens: what rounding down leaves, less than a
token for each node, is not dealt.

Edge cases: null language and source are values like others (shown as null); null or empty texts have no tokens, are
never taken and don't fail; repeated rows each take their place (equal ids by their tokens); an
empty table gives no rows; no budget gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import materialize

SEED, EPOCHS, SHARE = 17, 4, 0.6
#: Tokens of a hash range, about, and ranges of a leaf at most.
RANGE_TOKENS, MOST_RANGES = 50_000, 1 << 20
#: Weights of languages; others weigh 1. Domains and sources weigh by rule.
LANG_WEIGHT = {"en": 4, "de": 2, "fr": 2, "es": 1}
DOMAINS = 4
LEAF = ("domain", "lang", "source")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def number(source: Column) -> Column:
    """The digits of a source's name; 0 without any."""
    return F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1).try_cast("long"), F.lit(0).cast("long"))


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, domain, n_tokens): a row for each document."""
    return docs.select(
        F.col("doc_id"),
        F.col("lang"),
        F.col("source"),
        F.concat(F.lit("domain"), (number(F.col("source")) % DOMAINS).cast("string")).alias("domain"),
        tokens(F.col("text")).alias("n_tokens"),
    )


def weights(leaves: DataFrame) -> DataFrame:
    """Adds w_domain, w_lang and w_source (whole numbers above 0)."""
    n = number(F.col("source"))
    lang = F.lit(1)
    for k, v in LANG_WEIGHT.items():
        lang = F.when(F.col("lang") == k, v).otherwise(lang)
    return leaves.withColumns({"w_domain": (n % DOMAINS + 1).cast("long"), "w_lang": lang.cast("long"), "w_source": (n % 3 + 1).cast("long")})


def poured(nodes: DataFrame, parent: list[str], weight: str) -> DataFrame:
    """Adds `budget` to nodes (parent columns, `total` of the parent, weight, cap): water-filling among siblings.

    In order of cap / weight, a node takes its whole capacity as long as that is no more than its share of what the
    nodes from it on get; from the first that takes less, all share what is left by weight.
    """
    order = [F.col("cap") / F.col(weight), *(F.col(c) for c in LEAF if c in nodes.columns)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    sofar = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = nodes.withColumns({"_taken": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_rest": F.sum(weight).over(onward)})
    full = F.col("cap") * F.col("_rest") <= (F.col("total") - F.col("_taken")) * F.col(weight)
    got = got.withColumn("_short", F.max((~full).cast("int")).over(sofar))
    first = Window.partitionBy(*parent)
    got = got.withColumns(
        {
            "_left": F.max(F.when(F.col("_short") == 1, F.col("total") - F.col("_taken"))).over(first),
            "_weight": F.max(F.when(F.col("_short") == 1, F.col("_rest"))).over(first),
        }
    )
    part = F.floor(F.col("_left") * F.col(weight) / F.col("_weight")).cast("long")
    return got.withColumn("budget", F.when(F.col("_short") == 0, F.col("cap")).otherwise(F.least("cap", part))).drop("_taken", "_rest", "_short", "_left", "_weight")


def budgets(leaves: DataFrame, budget: Column, epochs: int = EPOCHS, weigh=weights) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with cap, weights and budget; `budget` is an expression over the tokens of all.

    weigh adds w_domain, w_lang and w_source, whole numbers above 0, to the leaves.
    """
    leaf = weigh(leaves).withColumn("cap", F.col("tokens") * epochs)
    lang = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w_lang"), F.max("w_domain").alias("w_domain"), F.sum("tokens").alias("tokens"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w_domain"), F.sum("tokens").alias("tokens"))
    root = domain.agg(F.sum("tokens").alias("_all")).select(budget.alias("total"))
    d = poured(domain.join(F.broadcast(root)), [F.lit(0)], "w_domain").select("domain", F.col("budget").alias("total"))
    g = poured(lang.join(d, "domain"), ["domain"], "w_lang").select("domain", "lang", F.col("budget").alias("total"))
    same = (leaf["domain"] == g["domain"]) & leaf["lang"].eqNullSafe(g["lang"])
    return poured(leaf.join(g, same).select(leaf["*"], "total"), ["domain", "lang"], "w_source").select(*LEAF, "tokens", "cap", "budget")


def selected(docs: DataFrame, share: float = SHARE, seed: int = SEED, epochs: int = EPOCHS, range_tokens: int = RANGE_TOKENS, weigh=weights) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, taken): each copy of a document that is taken, and its tokens within the budget."""
    rows = materialize(placed(docs).where("n_tokens > 0"), "tokens")  # texts are read and counted once
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, F.floor(F.col("_all") * share).cast("long"), epochs, weigh).where("budget > 0").select(
        *(F.col(c).alias(f"_{c}") for c in LEAF), F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("last"), F.least(F.lit(MOST_RANGES), F.ceil(F.col("tokens") / range_tokens)).cast("long").alias("_ranges")
    )
    on = (F.col("domain") == F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    got = rows.join(plan, on).select("doc_id", *LEAF, "n_tokens", "whole", "last", "_ranges")
    full = got.where("whole > 0").select("doc_id", *LEAF, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    part = got.where("last > 0").withColumn("_key", key).withColumn("_range", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_ranges"), 32).cast("int"))
    sums = part.groupBy(*LEAF, "_range").agg(F.sum("n_tokens").alias("_n"))
    offsets = sums.select(*(F.col(c).alias(f"_{c}") for c in LEAF), F.col("_range").alias("_r"), (F.sum("_n").over(Window.partitionBy(*LEAF).orderBy("_range")) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy(*LEAF, "_range").orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed_at = part.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    begin = placed_at.join(offsets, on & (F.col("_range") == F.col("_r"))).withColumn("_start", F.col("_offset") + F.col("_before"))
    tail = begin.where("_start < last").select("doc_id", *LEAF, F.col("whole").alias("epoch"), "n_tokens", F.least(F.col("n_tokens"), F.col("last") - F.col("_start")).alias("taken"))
    return full.unionAll(tail)


def _case(col: str) -> str:
    return "case " + " ".join(f"when {col} = '{k}' then {v}" for k, v in LANG_WEIGHT.items()) + " else 1 end"


def _pour(nodes: str, parent: str, weight: str, keys: str, out: str) -> str:
    w = f"partition by {parent} order by cap / {weight}, {keys}"
    return f"""
{out}_a as (select *, coalesce(sum(cap) over ({w} rows between unbounded preceding and 1 preceding), 0) taken, sum({weight}) over ({w} rows between current row and unbounded following) rest from {nodes}),
{out}_b as (select *, max(case when cap * rest <= (total - taken) * {weight} then 0 else 1 end) over ({w}) short from {out}_a),
{out}_c as (select *, max(case when short = 1 then total - taken end) over (partition by {parent}) l, max(case when short = 1 then rest end) over (partition by {parent}) ws from {out}_b),
{out} as (select * exclude (taken, rest, short, l, ws), case when short = 0 then cap else least(cap, cast(floor(cast(l * {weight} as double) / cast(ws as double)) as bigint)) end budget from {out}_c)"""


#: The same result in DuckDB.
SQL = rf"""
with n as (select doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n_tokens, coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) as bigint), 0) num from documents),
r as (select doc_id, lang, source, 'domain' || (num % {DOMAINS}) as "domain", n_tokens, num % {DOMAINS} + 1 w_domain, {_case('lang')} w_lang, num % 3 + 1 w_source from n where n_tokens > 0),
leaf as (select domain, lang, source, sum(n_tokens) tokens, sum(n_tokens) * {EPOCHS} cap, max(w_domain) w_domain, max(w_lang) w_lang, max(w_source) w_source from r group by all),
lang0 as (select domain, lang, sum(cap) cap, sum(tokens) tokens, max(w_lang) w_lang, max(w_domain) w_domain from leaf group by all),
dom0 as (select domain, sum(cap) cap, sum(tokens) tokens, max(w_domain) w_domain from lang0 group by all),
root as (select cast(floor(cast(sum(tokens) as double) * {SHARE}) as bigint) total from dom0),
dom1 as (select * from dom0, root),{_pour('dom1', '1', 'w_domain', '"domain"', 'dom2')},
lang1 as (select lang0.*, dom2.budget total from lang0 join dom2 using ("domain")),{_pour('lang1', '"domain"', 'w_lang', '"domain", lang', 'lang2')},
leaf1 as (select leaf.*, lang2.budget total from leaf join lang2 on leaf.domain = lang2.domain and leaf.lang is not distinct from lang2.lang),{_pour('leaf1', '"domain", lang', 'w_source', '"domain", lang, source', 'leaf2')},
got as (select doc_id, r.domain, r.lang, r.source, n_tokens, cast(leaf2.budget // leaf2.tokens as bigint) whole, cast(leaf2.budget % leaf2.tokens as bigint) last from r join leaf2 on r.domain = leaf2.domain and r.lang is not distinct from leaf2.lang and r.source is not distinct from leaf2.source where leaf2.budget > 0),
tail as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('{SEED}:' || whole || ':' || coalesce(cast(doc_id as varchar), '-')), n_tokens rows between unbounded preceding and 1 preceding), 0) s from got where last > 0)
select doc_id, domain, lang, source, cast(unnest(range(whole)) as bigint) epoch, cast(n_tokens as bigint) n_tokens, cast(n_tokens as bigint) taken from got where whole > 0
union all
select doc_id, domain, lang, source, whole, cast(n_tokens as bigint), cast(least(n_tokens, last - s) as bigint) from tail where s < last
"""
