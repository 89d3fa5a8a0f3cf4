"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

DataFrame functions alone. Words are `[^\\x20\\x09-\\x0D]+`, A-Z as a-z, without marks at their ends; a shingle is five
words in a row (a template of fewer words is one shingle). Templates are partitioned by their number of shingles; for a
partition whose longest template has q shingles, a text is cut into windows of 2q shingles every q, so that a passage
as long as the template lies whole in one window. Each window gets `BANDS` MinHash values per partition, each a band of
one row. A template of m shingles that lies at 80 % in a window of 2q shingles shares a band with probability
J = 0.8 m / (2 q + 0.2 m) at least. For m = q that is 0.36, and all 48 bands miss with probability 0.64^48 < 1e-9; for the
smallest template of a partition, m = q / 2, it is 0.19 and 0.81^48 < 5e-5 (an exact copy: 0.25, 1e-6). A passage of whose
shingles less lies in any one window has no such bound. What a band retrieves is verified: a template is reported if
80 % of its distinct shingles lie in the whole text.

Only texts that hold a template's anchor words are cut: if 80 % of the shingles are there, not all of its anchor words
can be missing: more shingles contain one of them than may be missing. Texts without any of them can't match, and
the test costs one pass over the text.

Edge cases: null and empty texts match nothing; repeated rows and ids give a row each; templates without words and an
empty table of templates match nothing; a license that occurs several times gives one row; the number of windows of a
very long text is bounded by its length only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import materialize

PERCENT, BANDS, WIDTH = 80, 48, 5
#: Names and texts of license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"""["'.,;:!?()\[\]{}<>*#$%&|/-]"""


def words(text: Column) -> Column:
    """Normalised words of a text, those that are only marks left out."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    bare = F.regexp_replace(low, rf"(?<![^\x20\x09-\x0D]){MARKS}+|{MARKS}++(?![^\x20\x09-\x0D])", "")
    return F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def py_words(text: str | None) -> list[str]:
    """The same in Python, for the few templates."""
    low = (text or "").translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(rf"(?<![^\x20\x09-\x0D]){MARKS}+|{MARKS}+(?![^\x20\x09-\x0D])", "", low)) if w]


def py_shingles(text: str | None) -> list[str]:
    w = py_words(text)
    return sorted({" ".join(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))}) if w else []


def anchors(text: str, percent: int = PERCENT) -> list[str]:
    """Words of a template of which at least one is in every text that holds `percent` of its shingles.

    The longest words are taken until more shingles contain one of them than may be missing.
    """
    shingles, taken = py_shingles(text), []
    for word in sorted(set(py_words(text)), key=lambda x: (-len(x), x)):
        taken.append(word)
        if sum(any(t in s.split(" ") for t in taken) for s in shingles) > len(shingles) * (100 - percent) // 100:
            break
    return taken


def holds_anchor(text: Column, templates=TEMPLATES) -> Column:
    """Whether a text has an anchor word; written as one pattern without backtracking."""
    every = sorted({a for _, t in templates if py_words(t) for a in anchors(t)})
    if not every:
        return F.lit(False)
    either = "|".join(re.sub(r"([^a-z0-9])", r"\\\1", a) for a in every)
    return F.translate(text, UPPER, LOWER).rlike(f"(?:{either})")


def partitions(templates, factor: float = 2.0) -> dict[int, list[tuple[str, list[str], int]]]:
    """Templates (name, shingles, words in a shingle) by the largest number of shingles of their partition."""
    found: dict[int, list] = {}
    sized = sorted(((len(s), name, s, min(WIDTH, len(py_words(t)))) for name, t in templates if (s := py_shingles(t))), reverse=True)
    top = 0
    for n, name, s, width in sized:
        if not top or n * factor < top:
            top = n
        found.setdefault(top, []).append((name, s, width))
    return found


def constant(spark, rows: list[tuple], names: str) -> DataFrame:
    """A table of literals, as large as the list it is made of."""
    value = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(value(x).alias(n) for n, x in zip(names.split(), r))) for r in rows))))


def minhash(hashes: Column, bands: int) -> Column:
    """Bands (band, value) of one row each: the least of a hash of each element with the band's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, b))).alias("value")))


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, n_shingles, n_shared, containment): a row for each license in each document."""
    spark = docs.sparkSession
    parts = partitions(templates)
    sets = [(name, width, s) for rows in parts.values() for name, s, width in rows]
    if not sets:
        return spark.createDataFrame([], "doc_id long, license string, n_shingles long, n_shared long, containment double")
    known = constant(spark, sets, "license width sh")
    widths = sorted({w for _, w, _ in sets})

    def grams(n: int) -> Column:
        last = F.size("w") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    held = docs.select("doc_id", "text").where(holds_anchor(F.col("text"), templates)).select("doc_id", words(F.col("text")).alias("w"))
    cut = held.select("doc_id", F.monotonically_increasing_id().alias("_row"), *(grams(n).alias(f"g{n}") for n in widths))
    cut = materialize(cut, "licenses")  # each partition of templates reads the few texts that hold an anchor again
    found = None
    for top, rows in parts.items():
        for n in sorted({w for _, _, w in rows}):
            tpl = constant(spark, [(name, s) for name, s, w in rows if w == n], "license s")
            index = tpl.select("license", F.inline(minhash(F.transform("s", lambda g: F.xxhash64(g)), bands)))
            own = cut.where(F.size(f"g{n}") > 0).select("_row", F.transform(f"g{n}", lambda g: F.xxhash64(g)).alias("h"))
            starts = F.sequence(F.lit(1), F.size("h"), F.lit(top))
            windows = own.select("_row", F.explode(F.transform(starts, lambda i: F.slice("h", i, 2 * top))).alias("win"))
            hit = windows.select("_row", F.inline(minhash(F.col("win"), bands))).join(F.broadcast(index), ["band", "value"]).select("_row", "license").distinct()
            found = hit if found is None else found.unionAll(hit)
    both = found.join(F.broadcast(known), "license").join(cut, "_row")
    shared = F.lit(None)
    for n in widths:
        shared = F.when(F.col("width") == n, F.size(F.array_intersect("sh", f"g{n}"))).otherwise(shared)
    counted = both.select("doc_id", "license", F.size("sh").cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    return counted.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(templates=TEMPLATES, percent: int = PERCENT) -> str:
    """The same result in DuckDB: all shingles of all texts against all templates."""
    rows = ", ".join(f"({_quoted(name)}, {min(WIDTH, len(py_words(t)))}, [{', '.join(map(_quoted, s))}])" for name, t in templates if (s := py_shingles(t)))
    marks = MARKS.replace("'", "''")
    return rf"""
with t(license, width, sh) as (values {rows}),
w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') raw from documents),
b as (select doc_id, list_filter(list_transform(raw, lambda x: regexp_replace(regexp_replace(x, '^{marks}+', ''), '{marks}+$', '')), lambda x: x <> '') ws from w),
g as (select doc_id, width, list_distinct(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(list_slice(ws, i, i + width - 1), ' '))) g from b, (select distinct width from t)),
c as (select doc_id, license, cast(len(sh) as bigint) n_shingles, cast(len(list_intersect(sh, g)) as bigint) n_shared from g join t using (width))
select doc_id, license, n_shingles, n_shared, n_shared / n_shingles::double containment from c where n_shared * 100 >= n_shingles * {percent}
"""
