"""Centroid clustering of vectors by sort-means: exact k-means rounds that skip centroids the triangle inequality rules out.

A vector's components become whole numbers floor(64 * x), so distances, sums and centroids are exact and don't depend
on the order of rows. In each round, for every centroid c the others are put in order of their distance from c. A vector
last assigned to c is at distance d from c; it scans the others in that order and stops at the first whose distance from
c is strictly above 2 d: that one and all after it are farther from the vector than c, by the triangle inequality. Not
at equality, since a tie goes to the smaller number. Before the first round every vector counts as assigned to 0.

Tasks assign their batches in numpy, for all vectors of one previous assignment together (those sorted by d, so that
who still scans is a prefix). The vectors of a round are a written table; new centroids are componentwise sums
by cluster, combined in each task before the exchange, so a cluster with most of the rows is no large task. The driver
holds the centroids alone: `k` times `dims` numbers.

Edge cases: vectors of another length, null ones and those with null or non-finite components are left out; components
outside +-2^27 after scaling count as the bound, so that squared distances fit 64 bits; null ids are hashed as `1:null`;
repeated rows each count and each give a row, equal hashes go by their components; with fewer than k vectors there are
fewer centroids; an empty table gives no rows; inertias above 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import discard, materialize

K, DIMS, ROUNDS, SEED, SCALE = 16, 64, 3, 1, 64
#: Components beyond this count as this: 64 squares of twice as much stay below 2^63.
MOST = 1 << 27


def quantized(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): vectors of `dims` finite components, as whole numbers."""
    fit = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    return vectors.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("embedding", whole).alias("v"))


def seed_hash(vec_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("null"))).cast("binary"), 256)


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hashes: a top-k, of which each task sends k at most."""
    first = vectors.select(seed_hash(F.col("vec_id"), seed).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (smaller number on ties) and squared distance of each point, and how many distances were taken."""
    k = len(centroids)
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    cluster, dist = last.astype(np.int64), np.zeros(len(points), np.int64)
    taken = 0
    for c in np.unique(last):
        rows = np.flatnonzero(last == c)
        own = ((points[rows] - centroids[c]) ** 2).sum(1)
        place = np.argsort(-own, kind="stable")  # the farthest scan longest
        rows, own = rows[place], own[place]
        group, best, number, far = points[rows], own.copy(), np.full(len(rows), c), -own
        others = np.argsort(between[c], kind="stable")
        taken += len(rows)
        for j in others[others != c]:
            # scanning on: between <= 4 own, without leaving 64 bits
            n = int(np.searchsorted(far, -(-(-between[c, j] // 4)), side="right"))
            if not n:
                break
            d = ((group[:n] - centroids[j]) ** 2).sum(1)
            better = (d < best[:n]) | ((d == best[:n]) & (j < number[:n]))
            best[:n][better], number[:n][better] = d[better], j
            taken += n
        cluster[rows], dist[rows] = number, best
    return cluster, dist, taken


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cluster, distance): vectors (vec_id, v, cluster: the last one) with their nearest centroid."""
    if not len(centroids):
        return vectors.select("vec_id", "v", "cluster", F.lit(0).cast("long").alias("distance"))
    dims = centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            points = v.flatten().to_numpy().astype(np.int64).reshape(len(b), dims)
            cluster, dist, _ = nearest(points, centroids, b.column("cluster").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(cluster, pa.int32()), pa.array(dist)], names=["vec_id", "v", "cluster", "distance"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "v", "cluster").mapInArrow(task, f"vec_id {kind}, v array<int>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as the floor of the exact mean of their vectors; those without vectors stay."""
    dims = centroids.shape[1]
    sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) after `rounds` of assignment and update and a last assignment; the final centroids."""
    rows = materialize(quantized(vectors, dims).withColumn("cluster", F.lit(0)), "vectors")
    centroids = seeds(rows, k, seed).reshape(-1, dims)
    for _ in range(rounds):
        new = materialize(assigned(rows, centroids), "assigned")
        discard(rows)
        rows, centroids = new, moved(new, centroids)
    out = materialize(assigned(rows, centroids), "assigned")
    discard(rows)
    return out, centroids


def report(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    rows, centroids = clusters(vectors, **how)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    own = F.array(*(F.lit(fits(sums.get(c, 0))).cast("long") for c in range(len(digest)))).cast("array<bigint>")
    sha = F.array(*map(F.lit, digest)).cast("array<string>")
    at = lambda a: F.get(a, F.col("cluster"))
    return rows.select("vec_id", "cluster", "distance", at(own).alias("cluster_inertia"), F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), at(sha).alias("centroid_sha256"))


def _sql() -> str:
    """Plain k-means of the same rounds in DuckDB: every distance of every vector."""
    parts = [
        f"""with n as (select row_number() over () r, vec_id, embedding e from embeddings),
k as materialized (select r, vec_id, list_transform(e, lambda x: cast(floor(least(greatest(cast(x as double) * {SCALE}, -{MOST}.0), {MOST}.0)) as bigint)) v from n
  where len(e) = {DIMS} and len(list_filter(e, lambda x: x is not null and isfinite(x))) = {DIMS}),
p as materialized (select r, unnest(v) x, unnest(range({DIMS})) i from k),
s as (select v, row_number() over (order by sha256('{SEED}:' || coalesce(cast(vec_id as varchar), 'null')), v) - 1 c from k qualify c < {K}),
c0 as materialized (select c, unnest(v) y, unnest(range({DIMS})) i from s)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} as (select r, c, sum((x - y) * (x - y)) d from p join c{i} using (i) group by r, c)")
        parts.append(f"a{i} as materialized (select r, c, d from d{i} qualify row_number() over (partition by r order by d, c) = 1)")
        if i < ROUNDS:
            parts.append(f"m{i} as (select c, i, cast(floor(sum(x)::hugeint::decimal(38,0)) as hugeint) s, count(*) n from a{i} join p using (r) group by c, i)")
            # `//` rounds towards 0
            parts.append(f"c{i + 1} as materialized (select c, i, cast(coalesce(case when s < 0 then -((-s + n - 1) // n) else s // n end, y) as bigint) y from c{i} left join m{i} using (c, i))")
    last = ROUNDS
    return (
        ",\n".join(parts)
        + f""",
h as (select c, sha256(string_agg(cast(y as varchar), ',' order by i)) centroid_sha256 from c{last} group by c)
select vec_id, cast(c as integer) "cluster", cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, centroid_sha256
from a{last} join k using (r) join h using (c)"""
    )


SQL = _sql()
