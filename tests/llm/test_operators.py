"""Operators of the training-data subpackage against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import decontaminate, jaccard, licenses, media, mixing, pii, shards, substrings, suffixes, textkit, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for k, v in more.items():
        df = df.withColumn(k, F.lit(v))
    return df


def mixed(seed, n=60, pool=12):
    """Texts made of shared passages, with edges: null, empty, blank, copies, repeats."""
    r = random.Random(seed)
    vocabulary = ["the", "Of", "and", "é", "x", "yz", "straße"] + [f"w{i}" for i in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(6, 40))] for _ in range(pool)]
    out = [None, "", " \t\n", "one", "a b c d", "a b c d e"]
    for _ in range(n):
        ws = [r.choice(vocabulary) for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 4)):
            ws += r.choice(passages) + [r.choice(vocabulary)]
        out.append(r.choice([" ", "  ", "\n"]).join(ws))
    return out + out[-5:] + [" ".join(["same"] * 40)]


def test_shingles_match_plain_python():
    for t in mixed(1):
        ws = WORD.findall(t or "")
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
        want = len({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}) if ws else 0
        grams, begin = textkit.shingle_sets(pa.array([t], pa.string()))
        assert grams.size == want == begin[1]


def brute_words(texts):
    seen, rows = {}, []
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        for j in range(len(ws) - 12):
            seen.setdefault(tuple(ws[j : j + 13]), i)
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        gone = [False] * len(ws)
        for j in range(len(ws) - 12):
            if seen[tuple(ws[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        rows.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("seed,size", [(2, 1 << 20), (3, 2000)])
def test_word_windows(spark, monkeypatch, seed, size):
    real = shards.count
    monkeypatch.setattr(shards, "count", lambda d, shard_bytes=size, text="text": real(d, size, text))
    texts = mixed(seed)
    got = sorted(tuple(r) for r in substrings.deduplicate(docs(spark, texts, shard=1, blob=2)).collect())
    assert got == brute_words(texts) and any(r[2] for r in got)


def brute_bytes(texts):
    seen, rows = set(), []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        rows.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


@pytest.mark.parametrize("seed,size", [(4, 1 << 20), (5, 2500)])
def test_byte_strings(spark, monkeypatch, seed, size):
    real = shards.count
    monkeypatch.setattr(shards, "count", lambda d, shard_bytes=size, text="text": real(d, size, text))
    texts = mixed(seed) + ["ab" * 200, "a" * 99, "a" * 100, "a" * 300]
    got = sorted(tuple(r) for r in suffixes.deduplicate(docs(spark, texts)).collect())
    assert got == brute_bytes(texts) and any(r[2] for r in got)


def test_windows_of_null_and_repeated_ids(spark):
    """Rows of one id are one document to op2 and follow each other by their text in op6; null ids come last."""
    a, b = (" ".join(f"{x}{i:04d}" for i in range(40)) for x in "ab")
    rows = [(None, a), (7, a), (7, b), (7, b), (3, a + " tail"), (None, None), (9, ""), (None, b)]
    d = spark.createDataFrame([(i, t, "kept", 0) for i, t in rows], "doc_id long, text string, removed string, n_words int")
    got = sorted(map(str, (tuple(r)[:3] for r in substrings.deduplicate(d).collect())))
    assert got == sorted(map(str, [(None, 40, 40), (7, 40, 40), (7, 40, 0), (7, 40, 0), (3, 41, 0), (None, 0, 0), (9, 0, 0), (None, 40, 40)]))
    size = len(a)
    got = sorted(map(str, (tuple(r)[:3] for r in suffixes.deduplicate(d).collect())))
    assert got == sorted(map(str, [(None, size, size), (7, size, size), (7, size, 0), (7, size, size), (3, size + 5, 0), (None, 0, 0), (9, 0, 0), (None, size, size)]))


def test_other_operators_take_repeated_rows(spark):
    """Repeated ids and rows give a row each; other columns, whatever their names, don't disturb."""
    texts = ["Released under the MIT License.", None, "mail a.b@example.com now", "", "x " * 30_000]
    d = spark.createDataFrame([(i % 2 or None, t, "en", "s1", 0, "x", "y") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string, source string, n_chars long, row string, uid string")
    assert media.media(d).count() == pii.report(d).count() == len(texts) * 2
    assert licenses.scan(d).count() == 2
    items = spark.createDataFrame([(1, "mail a.b@example.com now"), (1, None)], "item_id long, text string")
    assert decontaminate.contained(d, items).count() == 2
    left = decontaminate.decontaminate(d, items)
    assert left.columns == d.columns and left.count() == 8 and left.where("text like 'mail%'").count() == 0
    clean = pii.redact(d)
    assert clean.columns == d.columns and clean.where("text = 'mail [EMAIL] now'").count() == 2 and clean.where("text is null").count() == 2
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.toxicity(d, labels)
    assert scored.count() == 10 and toxicity.toxicity(d.limit(0), labels).count() == 0
    assert d.select(toxicity.held_out("doc_id").alias("h")).where("h is null").count() == 0


def test_adjacent_and_long_contexts(spark):
    """Words before a hit are those of the text, also if a hit stands there or a word is long."""
    long = "w" * 100
    rows = pii.spans(docs(spark, [f"a1@b.co c2@d.co end {long} tail 10.0.0.1", "(x@y.zz), two"])).collect()
    first = {o["inst"]: (o["before"].strip(), o["after"]) for o in rows[0]["base"]}
    assert first["c2@d.co"] == ("a1@b.co", "end") and first["10.0.0.1"] == (f"{long} tail", "")
    second = rows[1]["base"][0]
    assert (second["before"].strip(), second["after"]) == ("(", "),")


def test_suffix_array_and_prefixes():
    r = random.Random(6)
    text = bytes(r.choice(b"ab") for _ in range(500)) + b"abab" * 80
    buf, end = np.frombuffer(text, np.uint8), np.full(len(text), len(text))
    order, _ = suffixes.suffix_array(buf, end, depth=100)
    cut = [text[i : i + 100] for i in order]
    assert cut == sorted(cut)
    got = suffixes.common_prefixes(buf, end, order, most=100, stripe=16)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :], text[order[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == min(same, 100)


def twins(seed):
    """Passages alike in 128 to 130 bytes of few letters, so that tied places are followed by places in the other order."""
    r = random.Random(seed)
    rnd = lambda n: "".join(r.choice("ab") for _ in range(n))
    core = rnd(130)
    return [rnd(r.randint(1, 9)) + core[: r.choice([128, 129, 130])] + r.choice("ab") for _ in range(12)]


@pytest.mark.parametrize("seed", range(1, 8))
def test_prefixes_after_tied_places(seed):
    text = "".join(twins(seed)).encode()
    buf, end = np.frombuffer(text, np.uint8), np.full(len(text), len(text))
    order, _ = suffixes.suffix_array(buf, end)
    got = suffixes.common_prefixes(buf, end, order)
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :][:100], text[order[k] :][:100]
        assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_byte_strings_after_tied_places(spark):
    texts = ["".join(twins(seed)) for seed in range(1, 31)]
    assert sorted(tuple(r) for r in suffixes.deduplicate(docs(spark, texts)).collect()) == brute_bytes(texts)


def brute_classes(texts):
    sets = []
    for t in texts:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def near_copies(seed=7):
    r = random.Random(seed)
    texts = mixed(seed)
    for k in range(3):
        base = [f"v{r.randint(0, 400)}" for _ in range(120)]
        for _ in range(12):
            ws = list(base)
            for _ in range(r.randint(0, 4)):
                ws[r.randrange(len(ws))] = f"n{r.randint(0, 10**6)}"
            texts.append(" ".join(ws))
    return texts


def test_jaccard_classes(spark):
    texts = near_copies()
    got = sorted(tuple(r) for r in jaccard.classes(docs(spark, texts).select("doc_id", "text")).collect())
    assert got == brute_classes(texts)
    kept = [r["doc_id"] for r in jaccard.distinct_documents(docs(spark, texts, _root=1)).select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, _, c in got})


def test_jaccard_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " end"
    rows = [(5, a), (5, b), (7, near(a)), (3, near(b)), (None, a), (None, c), (9, near(c)), (9, ""), (9, ""), (9, near(c)), (None, None)]
    d = spark.createDataFrame([(i, t, "_kept", 1) for i, t in rows], "doc_id long, text string, row string, n int")
    got = sorted(map(str, (tuple(r) for r in jaccard.classes(d.select("doc_id", "text")).collect())))
    want = [(5, 56, 5), (5, 56, 3), (7, 57, 5), (3, 57, 3), (None, 56, 5), (None, 56, 9), (9, 57, 9), (9, 0, 9), (9, 0, 9), (9, 57, 9), (None, 0, None)]
    assert got == sorted(map(str, want))
    kept = jaccard.distinct_documents(d)
    assert kept.columns == d.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(5, a), (3, near(b)), (9, near(c)), (9, ""), (9, ""), (None, None)]))


def test_jaccard_large_blocks_and_long_texts(spark):
    """Blocks of more than a leaf's documents, several nodes deep; sets of thousands of shingles."""
    r = random.Random(17)
    base = [f"v{r.randint(0, 10**6)}" for _ in range(200)]
    texts = []
    for _ in range(180):  # near copies, a few words apart from the first, more from each other
        ws = list(base)
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(len(ws))] = f"n{r.randint(0, 10**6)}"
        texts.append(" ".join(ws))
    long = [f"z{r.randint(0, 10**6)}" for _ in range(20_000)]
    texts += [" ".join(long), " ".join(long[:-1000] + ["tail"]), " ".join(long[:15_900]), " ".join(f"y{r.randint(0, 10**6)}" for _ in range(20_000)), None, ""]
    got = sorted(tuple(x) for x in jaccard.classes(docs(spark, texts).select("doc_id", "text")).collect())
    assert got == brute_classes(texts)
    assert got[180][2] == got[181][2] == 180 and got[183][2] == 183


def test_rtree_prunes_nothing_alike():
    r = np.random.default_rng(8)
    for m in (2, 8, 9, 100, 400):
        points = r.poisson(4, (m, jaccard.GROUPS)).astype(np.uint8)
        sizes = points.sum(1).astype(np.int64)
        rest = sizes - r.integers(0, 60, m)
        tree = jaccard.RTree(points, sizes, rest)
        assert bool(tree.levels) == (m > jaccard.LEAF)
        for k in range(0, m, 1 + m // 10):
            need = jaccard.needed(sizes[k], sizes)
            ok = (5 * sizes >= 4 * sizes[k]) & (4 * sizes <= 5 * sizes[k]) & (np.minimum(rest, rest[k]) >= need)
            want = np.flatnonzero(ok & (jaccard.bound(points[k], points) >= need)).tolist()
            assert sorted(tree.search(k).tolist()) == want


def test_benchmark_items_in_documents(spark):
    r = random.Random(9)
    items = [" ".join(f"q{r.randint(0, 300)}" for _ in range(n)) for n in (3, 5, 12, 40, 60)] + ["", None]
    texts = mixed(9) + [f"pre {x} post" for x in items[:5]] + ["pre " + " ".join(items[3].split()[:36]), "x " + " ".join(items[4].split()[:20])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contained(docs(spark, texts), bench).collect()}

    def shingles(t, n):
        ws = [w.lower() for w in WORD.findall(t or "")]
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    want = set()
    for i, x in enumerate(items):
        n = min(5, len(WORD.findall(x or "")))
        own = shingles(x, n) if n else set()
        want |= {(d, i) for d, t in enumerate(texts) if own and 100 * len(own & shingles(t, n)) >= 80 * len(own)}
    assert got == want and len(want) >= 6
    left = decontaminate.decontaminate(docs(spark, texts, _hit=3), bench)
    assert left.columns[-1] == "_hit" and {x["doc_id"] for x in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_convolution_against_plain_loops():
    """Sums of embeddings, filters one to three words wide with empty words after the end, ReLU, maximum over the text."""
    texts = ["one", "", "a b", "Some words, and more words than three of them", None, "x y z"]
    m = toxicity.Model(3)
    for b in m.b:
        b += np.random.default_rng(1).normal(0, 0.1, b.shape).astype(np.float32)
    tok, first = toxicity.features(pa.array(texts, pa.string()))
    pool, _, _ = m.pooled(tok, first)
    for i in range(len(texts)):
        words = [sum(m.emb[k].astype(float) for k in t) for t in tok[first[i] : first[i + 1]]]
        want = []
        for width, w, b in zip(toxicity.WIDTHS, m.w, m.b):
            at = [b + sum(words[p + j] @ w[j].astype(float) for j in range(width) if p + j < len(words)) for p in range(len(words))]
            want += list(np.max([np.maximum(z, 0) for z in at], axis=0)) if at else [0.0] * toxicity.FILTERS
        assert pool[i] == pytest.approx(np.array(want), abs=1e-5)
    scores = m.score(pa.array(texts, pa.string()))
    assert scores == pytest.approx(1 / (1 + np.exp(-(pool @ m.out + m.bias))), abs=1e-6)


def test_toxicity_learns_and_keeps_edges(spark):
    r = random.Random(10)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = [r.choice(words) for _ in range(r.randint(5, 40))]
        if bad:
            ws[r.randrange(len(ws))] = r.choice(["vile", "awful"])
        rows.append((i, " ".join(ws), "en"))
        labels.append((i, int(bad)))
    rows += [(400, None, "en"), (401, "", None), (402, "vile", "xx"), (402, "vile", "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    y = spark.createDataFrame(labels + [(400, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(d, y, epochs=12).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["doc_id"] < 400 and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    right = sum((x["score"] >= 0.3) == (x["doc_id"] % 4 == 0) for x in held)
    assert right >= 0.9 * len(held)
    none = toxicity.toxicity(d, y.limit(0)).collect()
    assert {x["score"] for x in none} == {0.0}
    left = toxicity.reject(d.withColumn("score", F.lit(1)), y, epochs=12)
    assert left.columns == ["doc_id", "text", "lang", "score"] and left.count() < len(rows)


def test_urls(spark):
    pages = [(i, u) for i, u in enumerate(["http://A.Com/en/1", "https://x.example.com/en/7?q", "http://y.net/de/8", "http://m.example.net/de/81", "ftp://q.org/es/", "http://com/en", None, "nothing", "http://h", "http://a://b/c"])]
    pages += [(100 + i, f"http://spam{i % 3}.info/win/{i}") for i in range(30)] + [(200 + i, f"http://fine{i % 3}.info/read/{i}") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    known = df.select("url", F.when(F.col("page_id") >= 200, False).when(F.col("page_id") >= 100, True).alias("blocked"))
    got = {r["page_id"]: r for r in urls.judge(df, known).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.com", "/en/1", "com/en/", "block")
    assert (got[1]["rule"], got[1]["verdict"]) == ("example.com/en/7", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/de/", "allow")
    assert (got[3]["rule"], got[3]["verdict"]) == ("example.net/de/8", "block")
    assert got[4]["rule"] == "org/es/" and got[5]["rule"] is None
    assert (got[6]["host"], got[6]["path"]) == ("", "") == (got[7]["host"], got[7]["path"])
    assert (got[9]["host"], got[9]["path"]) == ("a:", "//b/c")
    assert all(got[100 + i]["verdict"] == "block" for i in range(30)) and all(got[200 + i]["verdict"] == "allow" for i in range(30))
    assert all(r["verdict"] == "allow" for r in urls.judge(df, known.limit(0)).where("rule is null").collect())


def test_url_rules_of_late_tokens(spark):
    host = "www.news-one.my-shop.example"
    bad = [f"https://{host}/a/b/c/d/e/f/buy/{i}?utm=1&win={i}" for i in range(20)]
    fine = [f"https://{host}/a/b/c/d/e/f/read/{i}?utm=1&ref={i}" for i in range(30)]
    new = ["http://else.org/?win=1", "http://else.org/x/buy/2", "http://else.org/x/read/3?ref=4"]
    rows = [(i, u, True if u in bad else False if u in fine else None) for i, u in enumerate(bad + fine + new)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df.select("page_id", "url"), df.select("url", "blocked")).collect()}
    assert [got[i] for i in range(53)] == ["block"] * 20 + ["allow"] * 30 + ["block", "block", "allow"]


def test_url_rules_against_all_subsets(spark):
    r = random.Random(14)
    url = lambda: "http://" + r.choice(["a-b.c", "d.c", "e.f"]) + "/" + "/".join(r.sample("uvwxyz", 3)) + f"/{r.randint(0, 99)}?" + r.choice(["p=1&q=2", "p=1", "s=3"])
    rows = [(u, r.random() < (0.9 if "/u/" in u and "q=" in u else 0.3)) for u in (url() for _ in range(120))] + [("http://d.c/u", True)] * 6
    seen = spark.createDataFrame(rows, "url string, blocked boolean").withColumn("tokens", urls.tokens(F.col("url"))).collect()
    n, bad = {}, {}
    for x in seen:
        for m in range(1, 1 << len(x["tokens"])):
            s = frozenset(t for k, t in enumerate(x["tokens"]) if m >> k & 1)
            n[s], bad[s] = n.get(s, 0) + 1, bad.get(s, 0) + x["blocked"]
    rules = [s for s in n if bad[s] >= 5 and bad[s] >= 0.6 * n[s]]
    more = spark.createDataFrame([(x["url"],) for x in seen] + [(url(),) for _ in range(120)], "url string").distinct()
    want = {x["url"] for x in more.withColumn("tokens", urls.tokens(F.col("url"))).collect() if any(s <= set(x["tokens"]) for s in rules)}
    mined = urls.mine(spark.createDataFrame(rows, "url string, blocked boolean"), support=0.0)
    assert {x["url"] for x in urls.matched(more, mined).collect()} == want and 0 < len(want) < more.count()


def test_media_round_trip(spark, monkeypatch):
    real = shards.count
    monkeypatch.setattr(shards, "count", lambda d, shard_bytes=3000, text="text": real(d, 3000, text))
    r = random.Random(11)
    long = "".join(r.choice("abcdef é") for _ in range(9000))
    texts = [None, "", "x", "é" * 96, long, long, long[:6000] + "tail", "z" * 20000]
    got = {x["doc_id"]: x for x in media.media(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert x["media_bytes"] == 44 + len(p)
    assert got[4]["feature"] == got[5]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]
    with pytest.raises(ValueError, match="damaged"):
        media.rebuild([media.digest(b"a")], {media.digest(b"a"): b"b"})
    data = media.payload(long.encode())
    assert b"".join(x for _, x in media.chunks(data)) == data and max(len(x) for _, x in media.chunks(data)) <= media.MOST


def test_operators_return_what_they_keep(spark):
    texts = mixed(15) + ["ab" * 200, "é" * 150, "é" * 150]
    words = {x["doc_id"]: x for x in substrings.kept(docs(spark, texts)).collect()}
    for i, n, gone, sha in brute_words(texts):
        assert hashlib.sha256(words[i]["kept"].encode()).hexdigest() == sha and len(words[i]["kept"].split()) == n - gone
    strings = {x["doc_id"]: x for x in suffixes.kept(docs(spark, texts)).collect()}
    for i, n, gone, spans, sha in brute_bytes(texts):
        b, runs = (texts[i] or "").encode(), strings[i]["removed"]
        left = b"".join(b[x:y] for x, y in zip([0, *(r["end"] for r in runs)], [*(r["start"] for r in runs), n]))
        assert left == strings[i]["kept"] and hashlib.sha256(left).hexdigest() == sha and len(runs) == spans
    for x in media.stored(docs(spark, texts)).collect():
        p = media.payload((texts[x["doc_id"]] or "").encode())
        assert x["media"] == media.wav(p) and x["recipe"] == [d for d, _ in media.chunks(p)]


def brute_pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (2 if i % 2 else 1)
            s += x - 9 if x > 9 else x
        return s % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark):
    r = random.Random(12)
    texts = [None, "", "x@y.com_z@w.org.", "a@b.com.c@d.com a..b@c..d", "😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 01.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111  4111  1111", "+1 (743) 555-3824 +1--3 +12345678901234567890", "1 " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c"]
    texts += ["".join(r.choice("a1@.+- 4_(😀é") for _ in range(r.randint(0, 50))) for _ in range(150)]
    got = {x["doc_id"]: x for x in pii.report(docs(spark, texts, base=1, other=2)).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(want.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_contexts_find_unseen_identifiers(spark):
    known = [f"please write to user{i}@mail.example today" for i in range(6)]
    texts = known + ["please write to agent-4711-x today", "nobody knows agent-9999-y here", "nothing"]
    got = {x["doc_id"]: x for x in pii.report(docs(spark, texts)).collect()}
    assert got[6]["spans"] == f"id:16:{16 + len('agent-4711-x')}" and got[7]["spans"] == "" and got[0]["n_email"] == 1
    clean = {x["doc_id"]: x["text"] for x in pii.redact(docs(spark, texts, _row=1)).collect()}
    assert clean[0] == "please write to [EMAIL] today" and clean[6] == "please write to [ID] today" and clean[8] == "nothing"


def test_identifiers_in_many_strong_patterns(spark):
    seeds = [f"alpha{k}x beta{k}y user{k}{a}@mail.example omega" for k in "abcdefghij" for a in "abc"]
    texts = seeds + [f"alpha{k}x beta{k}y agent-4711-x omega" for k in "abcdefghij"]
    got = {x["doc_id"]: x for x in pii.report(docs(spark, texts)).collect()}
    assert all(got[i]["spans"] == f"id:15:{15 + len('agent-4711-x')}" for i in range(30, 40)) and all(got[i]["n_id"] == 0 for i in range(30))
    assert pii.redact(docs(spark, texts)).where("text like '%4711%'").count() == 0


def test_licenses(spark):
    name, text = licenses.TEMPLATES[2]
    w = text.split()
    texts = [None, "", text, "before " * 30 + text.upper() + " after" * 30, " ".join(w[:-1]), " ".join(w[:6]), "licensed " * 50, text + " " + text]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, texts)).collect()}
    assert {d for d, k in got if k == name} == {2, 3, 4, 7}
    assert licenses.scan(docs(spark, texts), ()).count() == 0
    for _, t in licenses.TEMPLATES:
        s, a = licenses.py_shingles(t), licenses.anchors(t)
        assert sum(any(x in g.split() for x in a) for g in s) > len(s) * 20 // 100


def test_mixing_fills_budgets(spark):
    r = random.Random(13)
    rows = [(i, " ".join(["t"] * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["src0", "src1", "src4", "other", None]), 0) for i in range(300)] + [(300, None, "en", "src0", 0), (5, "a b", "en", "src0", 0)]
    df = spark.createDataFrame(rows, DOC)
    total = sum(len(x[1].split()) for x in rows if x[1])
    got = mixing.selected(df, share=1.5, epochs=2)
    taken = got.agg(F.sum("taken")).first()[0]
    assert 0 <= int(total * 1.5) - taken < 40
    again = sorted(map(str, mixing.selected(df, share=1.5, epochs=2).collect()))
    assert again == sorted(map(str, got.collect()))
    assert mixing.selected(df.limit(0)).count() == 0
    leaf = got.groupBy("domain", "lang", "source").agg(F.sum("taken").alias("t")).collect()
    assert len(leaf) > 5


def test_empty_tables(spark):
    d = docs(spark, ["x"]).limit(0)
    assert substrings.deduplicate(d).count() == suffixes.deduplicate(d).count() == media.media(d).count() == 0
    assert jaccard.classes(d.select("doc_id", "text")).count() == pii.report(d).count() == licenses.scan(d).count() == 0
    assert decontaminate.contained(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
