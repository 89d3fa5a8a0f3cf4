r"""Chat formatting of conversations as text with a loss mask, and reading it back, in Spark expressions alone.

A conversation's rows are collected as structs and sorted by turn; adjacent ones of one role are merged into a block by
slicing the sorted array at the places where the role changes, and a block is

    <turn>role<says>text<next>text</turn>\n

where `<next>` stands between the texts of merged rows, so that reading gives every row back. A control string inside a
role or text gets a backslash after its `<` (one more if it has some already): `</turn>` becomes `<\/turn>`, `<\/turn>`
becomes `<\\/turn>`. A mark begins with the only `<` in it and ends with the only `>`, so no text, whatever its ends, forms one
with what stands beside it, and taking one backslash away again gives the text. Nothing else changes.

The loss mask is the spans of the texts of the trained role: begin and end (exclusive) in UTF-8 bytes of the formatted
text, which can be cut out without counting characters from its start. Offsets are sums of lengths in two levels of
arrays (`running`), so the cost of a long conversation is linear, about.

Edge cases: null roles and texts count as empty; rows without a turn come first; rows of one turn go by role, then text;
repeated rows stay; rows with a null conv_id are one conversation; an empty table gives no rows; other columns, whatever
their names, are left out. A conversation is one string, hence one row of one task, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SAYS, NEXT, CLOSE = "<turn>", "<says>", "<next>", "</turn>"
TRAINED = "assistant"
CONTROL = r"(turn|says|next|/turn)>"
#: Elements that running() sums in one go.
STRIPE = 256
SCHEMA = "conv_id long, turn long, role string, text string"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)" + CONTROL, r"<\\$1$2>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)" + CONTROL, "<$1$2>")


def running(numbers: Column) -> Column:
    """Sums of what stands before each number of an array, and of all at last; stripes first, then within them."""

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start.cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    stripes = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(STRIPE))).otherwise(F.array().cast("array<int>"))
    part = lambda at: F.slice(numbers, at, STRIPE)
    total = lambda at: F.aggregate(part(at), F.lit(0).cast("long"), lambda a, x: a + x)
    begins = sums(F.transform(stripes, total), F.lit(0))
    inner = F.flatten(F.transform(stripes, lambda at, k: F.slice(sums(part(at), F.get(begins, k)), 1, F.least(F.lit(STRIPE), F.size(numbers) - at + 1))))
    return F.concat(inner, F.array(F.element_at(begins, -1)))


def blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, blocks): array of (role, texts), adjacent rows of one role in one block, roles and texts escaped."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", plain("role"), plain("text")))).alias("turns"))
    place = F.sequence(F.lit(0), F.size("turns") - 1)
    changes = F.filter(place, lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    turns = turns.withColumn("begins", changes)
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    merged = F.transform("begins", lambda at, k: F.struct(escaped(F.get("turns", at)["role"]).alias("role"), F.transform(F.slice("turns", at + 1, end(k) - at), lambda t: escaped(t["text"])).alias("texts")))
    return turns.select("conv_id", merged.alias("blocks"))


def formatted(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, mask): the text of each conversation and the spans (begin, end) in its UTF-8 bytes to train on."""
    df = blocks(conversations)
    lead = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(SAYS))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(lead(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE + "\n"))), "")
    # pieces in order: a text, and what stands around it (the first one's lead, marks between texts, the end)
    size = lambda x: F.octet_length(x).cast("long")
    piece = lambda gap, length, on: F.struct(gap.cast("long").alias("gap"), length.alias("length"), on.alias("on"))
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.transform(b["texts"], lambda t, i: piece(F.when(i == 0, size(lead(b))).otherwise(len(NEXT)), size(t), b["role"] == trained)),
                F.array(piece(F.lit(len(CLOSE) + 1), F.lit(0).cast("long"), F.lit(False))),
            ),
        )
    )
    df = df.select("conv_id", text.alias("formatted"), pieces.alias("pieces"))
    df = df.withColumn("before", running(F.transform("pieces", lambda p: p["gap"] + p["length"])))
    spans = F.transform("pieces", lambda p, i: F.struct((F.get("before", i) + p["gap"]).alias("begin"), (F.get("before", i) + p["gap"] + p["length"]).alias("end"), p["on"].alias("on")))
    mask = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["begin"], s["end"]))
    return df.select("conv_id", "formatted", mask.alias("mask"))


def turns(text: Column) -> Column:
    """The rows that a formatted text has, as (role, text), by its marks alone."""
    found = F.filter(F.split(text, CLOSE + "\n"), lambda b: b != "")

    def rows(block: Column) -> Column:
        halves = F.split(block, SAYS, 2)
        role = unescaped(F.substring(halves[0], len(OPEN) + 1, 1 << 30))
        return F.transform(F.split(halves[1], NEXT), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(found, rows))


def trained_texts(text: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, cut from the bytes of the formatted text."""
    whole = text.cast("binary")
    return F.transform(mask, lambda s: unescaped(F.substring(whole, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")).cast("string")))


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from what formatted() gives."""
    df = formatted(conversations)
    df = df.select("conv_id", turns(F.col("formatted")).alias("turns"), F.array_join(trained_texts(F.col("formatted"), F.col("mask")), "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


#: Fixed rows: a conversation that holds control strings.
PROBE_ID, PROBE = -7, r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose two texts look like marks."""
    rows = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], SCHEMA)
    return conversations.select("conv_id", "turn", "role", "text").unionAll(rows)


_ESC = r"length(regexp_replace({c}, '<(\\*)(turn|says|next|/turn)>', '<\\\1\2>', 'g'))"
SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text from conversations
  union all select {PROBE_ID}, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
o as (select *, row_number() over w rn, lag("role") over w is distinct from "role" starts from c window w as (partition by conv_id order by turn nulls first, "role", text))
select conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || text || chr(10), '' order by rn)) turns_sha256,
  cast(coalesce(sum(length(text)) filter ("role" = '{TRAINED}'), 0) as bigint) loss_chars, sha256(coalesce(string_agg(text, '' order by rn) filter ("role" = '{TRAINED}'), '')) loss_sha256,
  cast(sum({_ESC.format(c='text')} + case when starts then {len(OPEN + SAYS + CLOSE) + 1} + {_ESC.format(c='"role"')} else {len(NEXT)} end) as bigint) formatted_chars
from o group by conv_id"""
