"""Centroid clustering by sort-means, in exact integers.

Each round sorts, for every centroid, the other centroids by their distance from it.  A
vector starts at the centroid it had before, at distance d, and looks at the others in that
order; it stops at the first one that lies strictly beyond 2 d from the old centroid, since
by the triangle inequality none of the rest can be as near as the old one.  (One at exactly
2 d may be as near and have the smaller number, so it is still looked at.)

Vectors are kept as whole numbers floor(scale * x), packed in bytes; distances, sums and
floors are exact.  A round is one pass over a written table and a second one for the sums, of
which each task hands on one row for each centroid.  The driver sees the centroids only.

Defined results: vectors of another length, null vectors and vectors with a null or non-finite
component are left out; a null vec_id hashes as an empty string; rows with the same vec_id or
the same vector are rows like any other (as first centroids they are taken in the order of
hash, then packed components); centroids that attract nothing stay where they are; with fewer
kept vectors than centroids there is a centroid for each; an empty table gives an empty
result.  A distance or a sum of distances beyond a long is null (components beyond about
3e9); clusters and centroids are right at any size of components whose sums have at most
38 digits.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, small_batches, table, written

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
_LONG = 1 << 63

Centroids = list[list[int]]


def pack(vector: np.ndarray) -> bytes:
    """Whole numbers as bytes: a letter for their width (h, q) or t for decimal text, then the components."""
    top = max(abs(int(x)) for x in (vector.min(), vector.max())) if len(vector) else 0
    if top < 1 << 15:
        return b"h" + vector.astype("<i2").tobytes()
    if top < 1 << 62:
        return b"q" + vector.astype("<i8").tobytes()
    return b"t" + ",".join(str(int(x)) for x in vector).encode()


def unpack(packed: list[bytes]) -> np.ndarray:
    """One row for each packed vector; int64, or Python integers where a component needs them."""
    kinds = {p[:1] for p in packed}
    if kinds == {b"h"}:
        return np.frombuffer(b"".join(p[1:] for p in packed), "<i2").reshape(len(packed), -1).astype(np.int64)
    read = {b"h": lambda p: np.frombuffer(p, "<i2").tolist(), b"q": lambda p: np.frombuffer(p, "<i8").tolist(), b"t": lambda p: [int(x) for x in p.split(b",")]}
    rows = [read[p[:1]](p[1:]) for p in packed]
    return np.array(rows, object if b"t" in kinds else np.int64)


def _safe(*groups: np.ndarray) -> bool:
    """Whether squared distances between such rows, times four, fit 64 bits."""
    most = max((max(abs(int(g.min())), abs(int(g.max()))) for g in groups if g.size), default=0)
    width = max(g.shape[1] for g in groups)
    return width * (2 * most) ** 2 * 4 < _LONG


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles; ``scale`` is a power of two, so the product is exact."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0) < 1 << 62:
        return scaled.astype(np.int64)
    return np.array([[(scale * n) // d for n, d in (float(x).as_integer_ratio() for x in row)] for row in values], object)


def _packed(scale: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("vector")
            values = found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
            whole = whole_numbers(values, scale)
            yield pa.record_batch([batch.column("vec_id"), pa.array([pack(v) for v in whole], pa.binary())], ["vec_id", "v"])

    return run


def packed_vectors(vectors: DataFrame, scale: int = SCALE, length: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as packed whole numbers; ``vectors`` has vec_id and an array column embedding."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter((F.size("vector") == length) & finite).mapInArrow(_packed(scale, length), "vec_id long, v binary")


def nearest(vectors: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of its nearest centroid (ties: the smaller) and the squared distance.

    ``order[a]`` lists the other centroids by distance from a, ``away[a]`` those squared distances.
    """
    def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        gap = rows - to
        return (gap * gap).sum(axis=1)

    start = squared(vectors, centroids[before])
    best, at = start.copy(), before.copy()
    live = np.arange(len(vectors))
    for k in range(order.shape[1]):
        # the old centroid's distance bounds the scan: strictly beyond twice of it nothing is as near
        live = live[away[before[live], k] <= 4 * start[live]]
        if not len(live):
            break
        other = order[before[live], k]
        found = squared(vectors[live], centroids[other])
        better = (found < best[live]) | ((found == best[live]) & (other < at[live]))
        best[live[better]], at[live[better]] = found[better], other[better]
    return at, best


def sorted_others(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by squared distance from it (ties: the smaller number), and those distances."""
    n = len(centroids)
    order, away = np.zeros((n, n - 1), np.int64), np.zeros((n, n - 1), centroids.dtype)
    for a in range(n):
        gaps = ((centroids - centroids[a]) ** 2).sum(axis=1)
        others = sorted((b for b in range(n) if b != a), key=lambda b: (gaps[b], b))
        order[a], away[a] = others, gaps[others]
    return order, away


def _assigned(centroids: Centroids) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(centroids, object)
        narrow = max(abs(x) for c in centroids for x in c) < 1 << 62
        forms: dict[type, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unpack(batch.column("v").to_pylist())
            kind = np.int64 if narrow and vectors.dtype != object and _safe(vectors, exact) else object
            if kind not in forms:
                forms[kind] = (exact.astype(kind), *sorted_others(exact.astype(kind)))
            at, best = nearest(vectors.astype(kind), batch.column("cluster").to_numpy().astype(np.int64), *forms[kind])
            distance = [int(d) if d < _LONG else None for d in best] if kind is object else best
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), pa.array(at, pa.int32()), pa.array(distance, pa.int64())],
                ["vec_id", "v", "cluster", "distance"])

    return run


def assign(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """``rows`` (vec_id, v, cluster) with the nearest centroid as cluster and the squared distance to it."""
    return rows.select("vec_id", "v", "cluster").mapInArrow(_assigned(centroids), "vec_id long, v binary, cluster int, distance long")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each cluster that the task has seen: its vectors and the sums of their components."""
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        cluster, vectors = batch.column("cluster").to_numpy(), unpack(batch.column("v").to_pylist())
        if vectors.dtype != object and int(np.abs(vectors).max(initial=0)) * len(vectors) >= _LONG:
            vectors = vectors.astype(object)
        for c in np.unique(cluster).tolist():
            found = vectors[cluster == c]
            total = found.sum(axis=0).tolist()
            sums[c] = [x + y for x, y in zip(sums[c], total)] if c in sums else total
            counts[c] = counts.get(c, 0) + len(found)
    if counts:
        wide = pa.list_(pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([sums[c] for c in counts], wide)], ["cluster", "n", "sums"])


def moved(rows: DataFrame, centroids: Centroids) -> Centroids:
    """The centroids after a round: componentwise floor of the mean; those without vectors stay."""
    parts = rows.select("cluster", "v").mapInArrow(_sums, "cluster int, n long, sums array<decimal(38,0)>")
    # one row for each centroid comes back
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(len(centroids[0]))]).alias("sums")).collect()
    now = list(centroids)
    for r in total:
        now[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    return now


def first_centroids(rows: DataFrame, k: int, seed: str) -> Centroids:
    """The ``k`` vectors of smallest sha256 of ``seed:vec_id``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return [unpack([bytes(r["v"])])[0].tolist() for r in found]


def sort_means(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, length: int = DIMENSIONS, seed: str = SEED) -> tuple[DataFrame, Centroids]:
    """(vec_id, v, cluster, distance) for each kept vector after ``rounds`` rounds and a last assignment, and the centroids."""
    now = written(packed_vectors(vectors, scale, length).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(now, k, seed)
    if not centroids:
        return now.withColumn("distance", F.lit(0).cast("long")), centroids
    for left in range(rounds, -1, -1):
        after = written(assign(now, centroids), "assigned")
        drop_written(now)
        now = after
        if left:
            centroids = moved(now, centroids)
    return now, centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, length: int = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector."""
    rows, centroids = sort_means(vectors, k, rounds, scale, length, seed)
    spark = vectors.sparkSession
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: int(x) if x is not None and x < _LONG else None
    whole = fits(sum(int(d) for d in sums.values() if d is not None))
    about = [(c, fits(sums.get(c)), whole, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()) for c, centroid in enumerate(centroids)]
    of = spark.createDataFrame(about, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows: a bounded broadcast
    return rows.join(F.broadcast(of), rows["cluster"] == of["_cluster"]).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """Assignment to the centroids of round ``k`` and the centroids of the next."""
    return f"""
, p{k} AS (
  SELECT vec_id, number, sum((x - c) * (x - c)) AS d
  FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM w) JOIN c{k} USING (i) GROUP BY vec_id, number
), a{k} AS (
  SELECT vec_id, CAST(min_by(number, d * 64 + number) AS INTEGER) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM p{k} GROUP BY vec_id
), s{k} AS (
  SELECT cluster AS number, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM w) JOIN a{k} USING (vec_id) GROUP BY cluster, i
), c{k + 1} AS (
  SELECT number, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c FROM c{k} LEFT JOIN s{k} USING (number, i)
)"""


OP12_SQL = f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), f AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS number, v FROM w ORDER BY number LIMIT {CENTROIDS}
), c0 AS (
  SELECT number, unnest(range(1, 65)) AS i, unnest(v) AS c FROM f
){"".join(_round_sql(k) for k in range(ROUNDS + 1))}
, h AS (
  SELECT number, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY number
)
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN h ON h.number = a.cluster
"""
