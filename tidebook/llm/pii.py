"""Personal data: base patterns, and identifiers found by bootstrapped contexts; DataFrame functions alone.

Base spans (email, ip, card, phone) come from regular expressions that need no recursion or backtracking over long
runs: doubled dots and separators are first replaced by marks of equal length, which ends a match where the stated
pattern would end. Texts and matches are cut apart by `split`, and running sums of their lengths are the positions, in
code points.

Bootstrapping: base spans are the seeds. A lexical pattern is what surrounds a span: the two words before it, or the
word before and the word after, whole words of the text found by their number, whatever else is found near; what is
joined to a span without a blank is a word as well. Instances are seeds and every other word with a digit, of six characters or more. On
the graph of patterns and instances, scores go back and forth: a pattern scores the mean of its distinct instances'
scores if at least two good ones stand in it, an instance the chance that any of its patterns is right
(1 - prod(1 - score)), seeds stay at 1. After `ROUNDS` rounds unseen instances of a score of at least `ACCEPT` that stand in a
pattern of at least `PATTERN` are reported as spans of kind `id`. Seeds from outside (`seeds`) may be added.

Edge cases: null and empty texts have no spans; a span may touch either end; repeated rows and ids give a row each;
overlapping spans of different kinds are all reported; an empty table gives no rows; other columns are ignored, and
redact() leaves them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, PATTERN, ACCEPT = 3, 0.6, 0.6
_WS = r"\x20\x09-\x0D"
SPAN = "array<struct<start:int,kind:int,end:int,inst:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: in a lambda the optimizer would put its expression wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, op=lambda s, x: s + x) -> Column:
    """What stands before each element, added up (or by another `op` that 0 leaves as it is), in two levels of 256 so that
    long arrays don't cost their square."""

    def scan(a: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s"))
        return F.aggregate(a, zero, lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), op(acc["s"], x).alias("s")))

    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 256).cast("int") - 1), lambda b: scan(F.slice(a, b * 256 + 1, 256)))
    bases = lambda bs: scan(F.transform(bs, lambda b: b["s"]))["a"]
    joined = lambda bs: F.flatten(F.zip_with(bs, bases(bs), lambda b, base: F.transform(b["a"], lambda v: op(base, v))))
    return let(xs, lambda a: F.when(F.size(a) > 0, let(blocks(a), joined)).otherwise(F.array().cast("array<int>")))


def reached(spans_: Column) -> Column:
    """The farthest end before each of spans in order of their start."""
    return running(F.transform(spans_, lambda x: x["end"]), lambda s, x: F.greatest(s, x))


def flat(c: Column) -> Column:
    """Every blank a space."""
    return F.translate(c, "\t\n\x0b\x0c\r", "     ")


def found(df: DataFrame, name: str, text: Column, pattern: str, kind: int, maybe: Column, valid) -> DataFrame:
    """Adds column `name`: the matches of pattern in text as SPAN, those that `valid` holds for; none where `maybe` is false.

    Matches neither begin nor end with a blank, so runs of blanks before a match number the word it begins in.
    """
    none = F.array().cast("array<string>")
    blanks = lambda c: F.regexp_count(c, F.lit(f"[{_WS}]+")).cast("int")
    df = df.withColumn("_t", F.when(maybe, text).otherwise(""))
    df = df.withColumns({"_gap": F.when(F.col("_t") != "", F.split("_t", pattern, -1)).otherwise(none), "_hit": F.when(F.col("_t") != "", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none)})
    gaps = F.slice("_gap", 1, F.greatest(F.size("_hit"), F.lit(0)))
    df = df.withColumns(
        {
            "_at": running(F.zip_with(gaps, "_hit", lambda g, h: F.char_length(g) + F.char_length(h))),
            "_nth": running(F.zip_with(gaps, "_hit", lambda g, h: blanks(g) + blanks(h))),
            "_word": F.when(F.size("_hit") > 0, F.split("_t", f"[{_WS}]+", -1)).otherwise(none),
        }
    )

    def one(i):
        gap, hit = F.get("_gap", i), F.get("_hit", i)
        start, first = F.get("_at", i) + F.char_length(gap), F.get("_nth", i) + blanks(gap)
        word = lambda k: F.get("_word", k)
        joined, follows = F.substring_index(flat(gap), " ", -1), F.substring_index(flat(F.get("_gap", i + 1)), " ", 1)
        before = F.when(joined != "", F.concat_ws(" ", word(first - 1), joined)).otherwise(F.concat_ws(" ", word(first - 2), word(first - 1)))
        after = F.when(follows != "", follows).otherwise(F.coalesce(word(first + blanks(hit) + 1), F.lit("")))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(hit)).alias("end"), hit.alias("inst"), before.alias("before"), after.alias("after"))

    spans = F.when(F.size("_hit") > 0, F.filter(F.transform(F.sequence(F.lit(0), F.size("_hit") - 1), one), lambda x: valid(x["inst"]))).otherwise(F.array()).cast(SPAN)
    return df.withColumn(name, spans).drop("_t", "_gap", "_hit", "_at", "_nth", "_word")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(d)

    def add(acc, i):
        x = F.substring(d, n - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, other): base spans in order, and words with digits outside them (kind `id`)."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    byte = lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False))
    df = found(
        df, "email", F.regexp_replace(text, r"(?<=\.)\.", "_"), r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]", 0, F.instr(text, "@") > 0, lambda m: F.lit(True)
    )
    df = found(df, "ip", text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1, text.rlike(r"[0-9]\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), byte))
    df = found(
        df, "card", F.regexp_replace(text, r"(?<=[\x20-])[\x20-]", "_"), r"[0-9][0-9\x20-]*[0-9]", 2, text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m))
    )
    df = found(df, "phone", text, r"\+[0-9][\x20().0-9-]+[0-9]", 3, text.rlike(r"\+[0-9]"), lambda m: F.length(digits(m)).between(10, 15))
    df = found(df, "other", text, rf"(?<![^{_WS}])[^{_WS}0-9]*+[0-9][^{_WS}]*+", 4, digit, lambda m: F.length(m) >= 6)
    df = df.withColumn("base", F.array_sort(F.concat("email", "ip", "card", "phone")))
    apart = let(covered(F.col("base")), lambda cover: F.filter("other", lambda o: ~hidden(cover, o)))
    return df.select("doc_id", "base", F.when((F.size("base") > 0) & (F.size("other") > 0), apart).otherwise(F.col("other")).alias("other"))


def covered(spans_: Column) -> Column:
    """A byte for each character up to the last span's end: 1 where a span is.

    Spans in order add what they have beyond those before, so the whole is linear in spans and text.
    """
    marks = lambda bit, n: F.when(n > 0, F.repeat(F.lit(bit), n)).otherwise("")
    part = lambda f, x: F.concat(marks("0", x["start"] - f), marks("1", x["end"] - F.greatest(f, x["start"])))
    return F.array_join(F.zip_with(reached(spans_), spans_, part), "").cast("binary")


def hidden(cover: Column, o: Column) -> Column:
    """Whether a span meets one that made `cover`; bytes are cut out without counting from the start."""
    return F.contains(F.substring(cover, o["start"] + 1, o["end"] - o["start"]).cast("string"), F.lit("1"))


def pattern_list(o: Column) -> Column:
    """The lexical patterns around an occurrence: two words before; a word before and one after."""
    before, after = F.trim(F.lower(o["before"])), F.lower(o["after"])
    two, one = F.substring_index(before, " ", -2), F.substring_index(before, " ", -1)
    return F.filter(
        F.array(F.when(F.instr(two, " ") > 0, F.concat(F.lit("2:"), two)), F.when((one != "") & (after != ""), F.concat(F.lit("1:"), one, F.lit(" _ "), after))), lambda p: p.isNotNull()
    )


def bare(inst: Column) -> Column:
    """An instance without marks at its ends."""
    return F.regexp_replace(inst, r"(?:^[^\p{L}\p{N}+]+)|(?:[^\p{L}\p{N}]++$)", "")


def bootstrap(rows: DataFrame, rounds: int = ROUNDS, seeds: DataFrame | None = None) -> DataFrame:
    """(inst, pattern) pairs to accept, from rows of spans(): unseen instances of high score in patterns of high score."""
    occ = lambda c, seed: rows.select(F.explode(c).alias("o")).select(bare(F.col("o.inst")).alias("inst"), F.explode(pattern_list(F.col("o"))).alias("pattern"), F.lit(seed).alias("seed"))
    edges = occ("base", 1.0).unionAll(occ("other", 0.0)).groupBy("inst", "pattern").agg(F.max("seed").alias("seed"))
    if seeds is not None:
        named = seeds.select(bare(F.col("inst")).alias("inst"), F.lit(1.0).alias("given")).distinct()
        edges = edges.join(named, "inst", "left").select("inst", "pattern", F.greatest("seed", F.coalesce("given", F.lit(0.0))).alias("seed"))
    edges = materialize(edges, "patterns")
    known = edges.groupBy("inst").agg(F.max("seed").alias("score"))
    scored = None
    for _ in range(rounds):
        scored = edges.join(known, "inst").groupBy("pattern").agg(F.avg("score").alias("weight"), F.count_if(F.col("score") >= ACCEPT).alias("good")).where((F.col("good") >= 2) & (F.col("weight") > 0))
        none = F.sum(F.log1p(-F.least(F.col("weight"), F.lit(0.999))))
        known = edges.join(scored, "pattern", "left").groupBy("inst").agg(F.max("seed").alias("seed"), F.coalesce(none, F.lit(0.0)).alias("miss"))
        known = known.select("inst", (F.col("seed") == 1).alias("seeded"), F.when(F.col("seed") == 1, 1.0).otherwise(1 - F.exp("miss")).alias("score"))
    good = scored.where(F.col("weight") >= PATTERN).select("pattern")
    unseen = known.where((F.col("score") >= ACCEPT) & ~F.col("seeded")).select("inst")  # strong evidence rounds to a score of 1
    return edges.where("seed = 0").select("inst", "pattern").join(good, "pattern").join(unseen, "inst").select("inst", "pattern")


def extract(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, _row, base, more): base spans and discovered ones (kind `id`) of every row."""
    rows = materialize(spans(docs).withColumn("_row", F.monotonically_increasing_id()), "spans")
    accepted = bootstrap(rows, **how)
    at = rows.select("_row", F.explode("other").alias("o")).select("_row", "o", bare(F.col("o.inst")).alias("inst"), F.explode(pattern_list(F.col("o"))).alias("pattern"))
    more = at.join(accepted, ["inst", "pattern"]).groupBy("_row").agg(F.array_sort(F.collect_set("o")).alias("more"))  # of one text
    return rows.select("doc_id", "_row", "base").join(more, "_row", "left").withColumn("more", F.coalesce("more", F.array().cast(SPAN)))


def written(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans."""
    got = extract(docs, **how)
    number = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    count = {f"n_{k}": number(i) for i, k in enumerate(KINDS[:4])}
    every = F.array_sort(F.concat("base", "more"))
    return got.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"), F.size("more").cast("long").alias("n_id"))


#: Characters of a piece of text that is cut without counting from the text's start.
CUT = 1024


def piece(cut: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text in pieces of CUT characters; empty where there are none."""
    part = lambda k: F.substring(F.get(cut, k), F.greatest(F.lit(0), start - k * CUT) + 1, F.least(end, (k + 1) * CUT) - F.greatest(start, k * CUT))
    return F.when(end > start, F.array_join(F.transform(F.sequence(F.floor(start / CUT).cast("int"), F.floor((end - 1) / CUT).cast("int")), part), "")).otherwise("")


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the first, longest one covers the rest.

    Rows are told apart by a written number, so that repeated ids don't meet; whole rows travel as one column beside it.
    """
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "redact")
    row = lambda c: F.col("row").getField(c)
    got = extract(keyed.select(F.col("key").alias("doc_id"), row("text").alias("text")), **how).where((F.size("base") > 0) | (F.size("more") > 0))
    both = keyed.join(got.select(F.col("doc_id").alias("key"), F.array_sort(F.concat("base", "more")).alias("spans")), "key", "left")
    name = lambda k: F.get(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k)
    both = both.withColumn("cut", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(row("text"), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)))).withColumn("far", F.when(F.col("spans").isNotNull(), reached(F.col("spans"))))
    last = F.greatest(F.element_at("far", -1), F.element_at("spans", -1)["end"])
    # a span that begins beyond all before it stands for itself; one within them adds to what they cover
    kept = lambda f, x: F.concat(piece(F.col("cut"), f, x["start"]), F.when(x["start"] >= f, name(x["kind"])).otherwise(""))
    text = F.concat(F.array_join(F.zip_with("far", "spans", kept), ""), piece(F.col("cut"), last, F.char_length(row("text"))))  # `cut` and `far` stand more than once: worked out before
    both = both.withColumn("clean", F.when(F.col("spans").isNull() | row("text").isNull(), row("text")).otherwise(text))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), row("n_chars")).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType))
    return both.select(*(new.get(c, row(c)).alias(c) for c in docs.columns))
