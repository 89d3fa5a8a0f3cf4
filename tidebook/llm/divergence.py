r"""Source divergence audit: how each source's words differ from those of other sources and of its whole language.

Terms are matches of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` (letters A-Z and all beyond ASCII), A-Z lower-cased. A language keeps the V terms
that at least `least` of its documents have. Each occurring (lang, source) group, and each language as a whole, gives a
kept term the smoothed share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the sum of its counts of kept terms. Two sources
differ by the sum of |p - q| over all kept terms; a source's own terms are those whose p is above the language's.

Plain relational: terms are exploded with a flag for the first of a document and counted in one aggregate; kept
vocabulary is crossed with the language's groups, which adds zeros to the counts; a self-join on language and term
gives each pair of sources its differences; windows rank. The crossing is a join on language and one of `SALTS` hashes
of the term, so that a language with most terms is many tasks, without a broadcast whose size nothing bounds. Zeros and
counts meet in one exchange by language and term, which the self-join then shares. Ranks of terms are cut to `top` by
Spark before their exchange, so a source with most of the terms sends few rows.

Edge cases: null text, lang and source are ''; a group without terms has counts of 0; a language without kept terms has
all pairs at 0 and no terms; rows count each as a document, repeated ones too; other columns, whatever their names, are
left out; an empty table gives no rows. Counts are exact up to 2^63, shares are taken in decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import discard, materialize

LEAST, TOP, UNIT, PRIOR = 30, 50, 1_000_000_000, 5
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts into which a language's vocabulary is dealt to meet the language's groups.
SALTS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term, and how many documents have it."""
    # a document's terms twice: all of them, and each once
    listed = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("_terms").alias("t")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("_terms").alias("t")))
    rows = docs.select("lang", "source", terms(F.col("text")).alias("_terms")).select("lang", "source", F.inline(listed)).select("lang", "source", "n", "d", F.explode("t").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("n_docs"))


def kept(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, whole, lead) of the terms that `least` documents of the language have; whole: n in the language; lead: true in one row a term."""
    term = Window.partitionBy("lang", "term")
    df = counted.withColumns({"_d": F.sum("n_docs").over(term), "whole": F.sum("n").over(term), "_first": F.min("source").over(term)})
    return df.where(F.col("_d") >= least).select("lang", "source", "term", "n", "whole", (F.col("source") == F.col("_first")).alias("lead"))


def groups(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v) of every occurring group: sums of kept counts, and the language's kept terms."""
    own = vocabulary.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("_v"))
    lang = Window.partitionBy("lang")  # a row for each source
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("lang", "source", zero(F.col("total")).alias("total"), zero(F.sum("total").over(lang)).alias("lang_total"), zero(F.sum("_v").over(lang)).alias("v"))


def share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * v)), exactly."""
    return F.expr(f"1 + (cast({UNIT} as decimal(11,0)) * cast({count} + {PRIOR} as decimal(19,0)) div cast({total} + {PRIOR} * v as decimal(19,0)))")


def dense(vocabulary: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, term, n, p, q) for each kept term and each group of its language; p: the group's share, q: the language's."""
    salted = F.sequence(F.lit(0), F.lit(SALTS - 1))
    terms_once = vocabulary.where("lead").select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("_salt"))
    zeros = terms_once.join(sources.select("lang", "source", F.explode(salted).alias("_salt")), ["lang", "_salt"]).select("lang", "term", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("whole"))
    all_rows = zeros.unionAll(vocabulary.select("lang", "term", "source", "n", F.when(F.col("lead"), F.col("whole")).otherwise(0).alias("whole"))).repartition("lang", "term")
    full = all_rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("whole").alias("_w"))
    full = full.withColumn("whole", F.sum("_w").over(Window.partitionBy("lang", "term")))
    totals = sources.select("lang", "source", "total", "lang_total", "v")
    return full.join(totals, ["lang", "source"]).select("lang", "source", "term", "n", share("n", "total").alias("p"), share("whole", "lang_total").alias("q"))


def pairs(table: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source against each other one of its language."""
    side = lambda name: table.select("lang", "term", F.col("source").alias(name), F.col("p").alias(f"{name}_p"))
    both = side("a").join(side("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("a_p") - F.col("b_p"))).alias("value"))
    bare = sources.where("v = 0")
    none = bare.select("lang", F.col("source").alias("a")).join(bare.select("lang", F.col("source").alias("b")), "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    return both.unionByName(none).select("lang", "value", F.inline(F.array(way("a", "b"), way("b", "a")))).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows of all other sources, `term` rows of the first `top` terms above the language's share."""
    rows = named(docs)
    vocabulary = materialize(kept(counts(rows), least), "vocabulary")
    sources = materialize(groups(rows, vocabulary), "groups")
    table = materialize(dense(vocabulary, sources), "dense")
    discard(vocabulary)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = table.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    other = pairs(table, sources).withColumn("rank", F.row_number().over(order))
    named_part = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return named_part(other, "pair").unionAll(named_part(own, "term"))


SQL = rf"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') t from documents),
e as materialized (select r, lang, source, unnest(t) term from d),
v as materialized (select lang, term from e group by lang, term having count(distinct r) >= {LEAST}),
g as materialized (select lang, source from d group by lang, source),
c as materialized (select lang, source, term, count(*) n from e semi join v using (lang, term) group by all),
x as materialized (select g.lang, g.source, v.term, coalesce(n, 0) n from g join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = v.term),
y as (select *, sum(n) over (partition by lang, term) w, sum(n) over (partition by lang, source) total, sum(n) over (partition by lang) lang_total, count(*) over (partition by lang, source) k from x),
z as materialized (select lang, source, term, n, 1 + {UNIT}::hugeint * (n + {PRIOR}) // (total + {PRIOR} * k) p, 1 + {UNIT}::hugeint * (w + {PRIOR}) // (lang_total + {PRIOR} * k) q from y),
pr as (select a.lang, a.source, b.source item, coalesce((select sum(abs(i.p - j.p)) from z i join z j using (lang, term) where i.lang = a.lang and i.source = a.source and j.source = b.source), 0) "value" from g a join g b on a.lang = b.lang and a.source <> b.source),
al as (select lang, source, 'pair' part, item, "value" from pr union all select lang, source, 'term', term, p - q from z where n > 0 and p > q)
select lang, source, part, item, cast("value" as bigint) "value", cast(row_number() over (partition by lang, source, part order by "value" desc, item) as integer) "rank"
from al qualify part = 'pair' or "rank" <= {TOP}
"""
