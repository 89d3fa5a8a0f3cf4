"""Clustering, chat formatting and the divergence audit against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import chat, clusters, decontaminate, divergence, pii, urls

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# clusters


def brute_kmeans(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, [max(-clusters.MOST, min(clusters.MOST, x)) for x in v]) for i, v in kept]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    got = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in got:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, ((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in got)))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(None).cast("int")}).repartition(3)


@pytest.mark.parametrize("seed,k,spread", [(1, 16, 1.0), (2, 5, 0.1), (3, 16, 0.01)])
def test_clusters(spark, seed, k, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (6, 4))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] + r.normal(0, spread, 4)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(150)]  # one vector a third of the time
    rows += [rows[0], rows[0], (None, [0.0, 1.0, 2.0, 3.0]), (None, [0.0, 1.0, 2.0, 3.5]), (2001, None), (2002, []), (2003, [1.0, 2.0, 3.0]), (2004, [1.0, None, 1.0, 1.0])]
    rows += [(2005, [math.nan, 0.0, 0.0, 0.0]), (2006, [0.0, math.inf, 0.0, 0.0]), (2007, [0.0, 0.0, 0.0, 0.0, 0.0])]
    got = clusters.report(vectors(spark, rows), k=k, dims=4)
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_kmeans(rows, k, 3, 4)


def test_clusters_of_few_or_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1e30, 1e30])]
    got = clusters.report(vectors(spark, rows), dims=2)
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_kmeans(rows, 16, 3, 2)
    none = clusters.report(vectors(spark, [(1, None)]), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_scans_stop_early_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(4)
    centroids = np.array([[0, 0], [10, 0], [0, 10], [1000, 1000], [1010, 1000], [10, 0]])
    points = np.vstack([centroids[r.integers(0, 6, 500)] + r.integers(-6, 7, (500, 2)), [[5, 0], [0, 5], [10, 0]]])
    last = r.integers(0, 6, len(points))
    every = ((points[:, None] - centroids[None]) ** 2).sum(2)
    cluster, dist, _ = clusters.nearest(points, centroids, last)
    assert (cluster == every.argmin(1)).all() and (dist == every.min(1)).all()
    _, _, taken = clusters.nearest(points, centroids, cluster)
    assert len(points) <= taken < 0.6 * every.size


# chat


CONV = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t is not None, t, (role or "").encode(), (text or "").encode()))
    out = []
    for c, turns in of.items():
        turns = [(r.decode(), t.decode()) for *_, r, t in sorted(turns, key=lambda x: (x[0], x[1] or 0, *x[2:]))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(map(str, out))


NASTY = ["", "<turn>", "</turn>\n", "<\\/turn>", "a<", "<\\\\says>", "\\", "tail\\", "</turn", "turn>", "<next>", "<<next>>", "é</turn>\né", "\n", "<says>\\<says>", chat.PROBE, None, "𝒳" * 3]


def test_chat_round_trip(spark):
    r = random.Random(5)
    rows = [(i, t, r.choice(["user", "assistant", "assistant", "system", None, "<says>", "Assistant"]), "".join(x or "" for x in r.choices(NASTY, k=r.randint(0, 4)))) for i in range(120) for t in range(r.randint(1, 9))]
    rows += [(200, 0, "assistant", x) for x in NASTY] + [(201, None, "user", "b"), (201, None, "user", "a"), (201, 0, "assistant", None), (201, 0, "assistant", None), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    rows += [(202, i, "assistant" if i % 3 else "user", NASTY[i % len(NASTY)]) for i in range(1500)] + [(203, 0, "assistant", "x" * 2_000_000)]
    df = spark.createDataFrame(rows, CONV).withColumns({"turns": F.lit(1), "role_": F.lit(""), "blocks": F.lit("b"), "begins": F.lit(2)})
    got = [tuple(x)[:5] for x in chat.report(df).collect()]
    assert sorted(map(str, got)) == brute_chat(rows)
    assert chat.report(df.limit(0)).count() == 0


def test_chat_text_and_mask(spark):
    rows = [(1, 2, "assistant", "Hi </turn>"), (1, 1, "user", "héllo"), (1, 3, "assistant", "more"), (1, 4, "user", "bye")]
    (got,) = chat.formatted(spark.createDataFrame(rows, CONV)).collect()
    assert got["formatted"] == "<turn>user<says>héllo</turn>\n<turn>assistant<says>Hi <\\/turn><next>more</turn>\n<turn>user<says>bye</turn>\n"
    data = got["formatted"].encode()
    assert [data[s["begin"] : s["end"]] for s in got["mask"]] == [b"Hi <\\/turn>", b"more"]


def test_chat_probe_and_plan(spark):
    df = chat.with_probe(spark.createDataFrame([(1, 0, "user", "x")], CONV))
    (got,) = chat.report(df).where("conv_id = -7").collect()
    assert (got["n_turns"], got["loss_chars"]) == (2, len(chat.PROBE))
    plan = chat.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    numbers = [(i * 7919) % 100 for i in range(n)]
    (got,) = spark.createDataFrame([(numbers,)], "x array<long>").select(chat.running(F.col("x"))).first()
    assert got == [sum(numbers[:i]) for i in range(n + 1)]


# divergence


def brute_audit(rows, least, top=50):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        n, v = {}, len(kept)
        for _, s, ts in own:
            n.setdefault(s, Counter()).update(t for t in ts if t in kept)
        whole = sum(n.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        for s, c in n.items():
            other = sorted((-sum(abs(p(c, t) - p(o, t)) for t in kept), i.encode()) for i, o in n.items() if i != s)
            terms = sorted((p(whole, t) - p(c, t), t.encode()) for t in kept if c[t] > 0 and p(c, t) > p(whole, t))[:top]
            for part, ranked in (("pair", other), ("term", terms)):
                out += [(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed,least", [(6, 1), (7, 3), (8, 30)])
def test_divergence(spark, seed, least):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "aBçÉ" for b in "xyzß日"] + ["don't", "x1y", "[", "@", "𝒳z"]
    rows = [(" ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s2", "é3", None])) for _ in range(200)]
    rows += [(None, "en", "s9"), ("", "xx", "s1"), ("one", "xx", "s2"), ("word " * 50_000, "en", "s1"), ("123 456", "yy", "s1")] + [("same text", "en", "s2")] * 60
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("t"), "n": F.lit(1), "total": F.lit("x"), "_terms": F.lit(0), "item": F.lit(3)})
    got = sorted(tuple(x) for x in divergence.audit(df, least).collect())
    assert got == brute_audit(rows, least) and any(x[2] == "term" for x in got)


def test_divergence_of_nothing_and_first_ranks(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0
    r = random.Random(9)
    rows = [(" ".join("".join(r.choices("abcdefgh", k=2)) for _ in range(60)), "en", f"s{i % 2}") for i in range(40)]
    got = sorted(tuple(x) for x in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 2, top=7).collect())
    assert got == brute_audit(rows, 2, 7)


# later changes to earlier operators


@pytest.mark.parametrize("n", [60, 240])
def test_items_and_documents_with_a_common_prompt(spark, n):
    """A prompt that all items and documents begin with makes no pairs: they follow what is really shared."""
    r = random.Random(n)
    prompt = " ".join(f"prompt{i}" for i in range(13))
    words = lambda k: " ".join(f"w{r.randint(0, 10**7)}" for _ in range(k))
    texts = [words(30) for _ in range(n)]
    items = spark.createDataFrame([(i, f"{prompt} {t}") for i, t in enumerate(texts)], "item_id long, text string")
    held = set(range(0, n, 5))
    docs = spark.createDataFrame([(i, f"{prompt} {texts[i] if i in held else words(30)} {words(5)}") for i in range(n)], "doc_id long, text string")
    own, least, mask, widths = decontaminate.prepared(items, decontaminate.PERCENT)
    some = decontaminate.marked(docs.select("text", F.struct("doc_id").alias("row")), mask, widths)
    assert some.count() == len(held)  # the others hold nothing but the prompt
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contained(docs, items).collect()}
    assert got == {(i, i) for i in held}


def test_filter_grows_with_the_items(spark):
    few = decontaminate.bloom(spark.range(1000).select((F.col("id") * 7919).alias("hash")))
    many = decontaminate.bloom(spark.range(600_000).select(F.xxhash64("id").alias("hash")))
    assert few.size * 8 == 1 << decontaminate.LEAST_BITS < many.size * 8
    h = np.array([r["h"] for r in spark.range(600_000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    assert decontaminate.inside(h, many).all()
    assert decontaminate.inside(np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64), many).mean() < 1e-3


def test_many_spans_in_one_text(spark):
    """Spans and words with digits side by side, thousands each: found, kept apart and replaced as in a short text."""
    n = 4000
    text = " ".join(f"mail é{'x' * (i % 7)} a{i}@b{i}.org word{i:05d} or c{i}@d.net,tail{i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "a.b@c.de x"), (3, None), (4, ""), (5, "𝒳 +1 (234) 567-8901@x.yz end 𝒳")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.spans(df).collect()}
    assert len(got[1]["base"]) == 2 * n and [o["inst"] for o in got[1]["other"]] == [f"word{i:05d}" for i in range(n)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    want = re.sub(r"[ac][0-9]+@[bd][0-9]*\.(org|net)", "[EMAIL]", text)
    assert re.sub(r"\[ID\]", "", clean[1]) == re.sub(r"word[0-9]{5}", "", want) or clean[1] == want
    assert clean[2] == "[EMAIL] x" and clean[3] is None and clean[4] == "" and clean[5] == "𝒳 [PHONE] end 𝒳"


@pytest.mark.parametrize("seed", [11, 12])
def test_overlapping_spans_are_replaced_once(spark, seed):
    """Against a plain walk over the spans in order."""
    r = random.Random(seed)
    texts = []
    for _ in range(60):
        texts.append("".join(r.choice(["a@b.co", "1.2.3.4", "+44 123 456 7890", " ", "é", "4539 1488 0343 6467", "x" * 1500, "-", "12"]) for _ in range(r.randint(0, 12))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: sorted((s["start"], s["kind"], s["end"]) for s in [*x["base"], *x["more"]]) for x in pii.extract(df).collect()}
    for x in pii.redact(df).collect():
        out, at = "", 0
        for start, kind, end in found[x["doc_id"]]:
            if start >= at:
                out += texts[x["doc_id"]][at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert x["text"] == out + texts[x["doc_id"]][at:]


@pytest.mark.parametrize("k", [8, 25])
def test_segments_together_and_apart(spark, k):
    """URLs that share a path of k segments, which others have alone: as many rules as pairs of classes, not 2^k."""
    shared = "/".join(f"seg{chr(97 + i)}" for i in range(k))
    bad = [f"http://h{'abcdef'[i]}.x/{shared}" for i in range(6)]
    fine = [f"http://g{'abcdef'[j]}.y/seg{chr(97 + i)}" for i in range(k) for j in range(6)]
    more = [f"http://z{chr(97 + i % 26)}.w/other" for i in range(60)]
    known = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in fine + more], "url string, blocked boolean")
    rules = urls.mine(known)
    assert 0 < rules.count() < 10 * k * k
    new = ["http://new.v/sega/segb", "http://new.v/sega", "http://new.v/" + shared]
    pages = spark.createDataFrame(list(enumerate(bad + fine + more + new)), "page_id long, url string")
    blocked = {x["url"] for x in urls.matched(pages, rules).collect()}
    assert blocked == {*bad, new[0], new[2]}


def test_no_transaction_is_long(spark):
    """Many items beside a pivot are mined in groups; rules of three tokens are all found."""
    r = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("http://s.t/" + "/".join("p" + x for x in sorted(r.sample(letters, 16))), None) for _ in range(160)]
    rows = [(u, "/pa/" in u and "/pz" in u or r.random() < 0.1) for u, _ in rows]
    known = spark.createDataFrame(rows, "url string, blocked boolean")
    groups = urls.pivoted(known.groupBy("url").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad")), 5)[1]
    assert groups.groupBy("pivot", "group").count().where(f"count > {urls.MOST // 2}").join(groups.groupBy("pivot").agg(F.count("*").alias("all")).where(f"all > {urls.MOST}"), "pivot").count() == 0
    rules = {frozenset(x["tokens"]): (x["n"], x["confidence"]) for x in urls.mine(known, support=0.0, least=12).collect()}
    have = [({t for t in x["tokens"] if t.startswith("path=")}, x["blocked"]) for x in known.withColumn("tokens", urls.tokens(F.col("url"))).collect()]
    for i, a in enumerate(letters):
        for b in letters[i + 1 :]:
            own = [bad for ts, bad in have if {f"path=p{a}", f"path=p{b}"} <= ts]
            if sum(own) >= 12 and sum(own) >= 0.6 * len(own):
                assert rules[frozenset({f"path=p{a}", f"path=p{b}"})] == (len(own), pytest.approx(sum(own) / len(own)))
    assert any(len(x) == 2 for x in rules)


def test_long_rules_beside_many_items(spark):
    """A rule of five tokens, none of whose parts is one, in three groups of six of the twenty items beside its pivot."""
    r = random.Random(15)
    letters = "abcdefghijklmnopqrst"
    own = "adhmq"
    url = lambda some: "http://s.t/" + "/".join("p" + x for x in sorted(some))
    rows = [(url(set(r.sample(letters, 11)) | set(own)), True) for _ in range(14)]
    rows += [(url((set(r.sample(letters, 12)) | set(own)) - {x}), False) for x in own for _ in range(14)] + [(url(set(letters) - set(own)), False)] * 60
    known = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = urls.mine(known, support=0.0, least=5)
    new = [url(own), *(url(set(own) - {x}) for x in own)]
    blocked = {x["url"] for x in urls.matched(spark.createDataFrame([(x,) for x in new], "url string"), rules).collect()}
    assert blocked == {url(own)}


def test_pages_of_odd_shapes(spark):
    rows = [("http://bad.x/win", True)] * 3000 + [(f"http://fine.y/{i}/read", False) for i in range(40)] + [(None, True), ("x", None), ("http://bad.x/" + "a" * 100_000, False)]
    known = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://bad.x/win"), (1, "http://bad.x/win"), (None, None), (2, "")], "page_id long, url string").withColumns({"_hit": F.lit("x"), "tokens": F.lit(1), "host": F.lit(2), "own": F.lit(3)})
    got = sorted(map(str, (tuple(x)[:2] + (x["verdict"],) for x in urls.judge(pages, known).collect())))
    assert got == sorted(map(str, [(1, "bad.x", "block"), (1, "bad.x", "block"), (None, "", "allow"), (2, "", "allow")]))
    assert urls.judge(pages.limit(0), known).count() == 0 == urls.judge(pages.limit(0), known.limit(0)).count()
