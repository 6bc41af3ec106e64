"""Centroid clustering of integer vectors with Yinyang bounds.

The centroids are dealt to groups once, by a few rounds of clustering among themselves. Each vector carries its cluster, an
upper bound of the distance to its centroid and, for each group, a lower bound of the distance to the group's other
centroids. When centroids move, the bounds give way by as much. A vector whose upper bound is below all its lower bounds
stays without a distance being taken; else its own distance is, and then only the groups whose bound is not above it are
scanned, exactly. Bounds are doubles with slack, distances that decide are integers, so ties go to the smaller number.

A round is one pass over the vectors and one aggregate; what reaches the driver are sums by cluster and component. The
vectors with their bounds are cut from their lineage in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import durable, table
from .vectors import in_slices, matrix

CLUSTERS, GROUPS, ROUNDS, WIDTH, SCALE, SEED = 16, 4, 3, 64, 64, 1
#: Components beyond this have squared distances beyond 64 bits; up to EXACT, doubles hold those of WIDTH components.
LARGEST, EXACT = 1 << 27, 1 << 22
#: What bounds may be off by rounding, relative and absolute.
SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers, a row of x by a row of c."""
    if x.size and c.size and max(np.abs(x).max(), np.abs(c).max()) * np.sqrt(x.shape[1] / WIDTH) >= EXACT:
        return np.stack([((x - r) ** 2).sum(1) for r in c], 1)
    a, b = x.astype(np.float64), c.astype(np.float64)
    return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)


def group(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by clustering them among themselves; the first ones are the first centers."""
    centers = centroids[:groups].astype(float)
    for _ in range(rounds):
        own = ((centroids[:, None, :] - centers) ** 2).sum(2).argmin(1)
        for g in np.unique(own):
            centers[g] = centroids[own == g].mean(0)
    return own


def first(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound, lower bound of each group, from all distances."""
    d = squared(x, c)
    cluster = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), cluster])
    d = d.astype(float)
    d[np.arange(len(x)), cluster] = np.inf
    return cluster, upper, np.stack([np.sqrt(d[:, own == g].min(1, initial=np.inf)) for g in range(own.max() + 1)], 1)


def again(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, own: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """first() after centroids have moved by drift, from the bounds of before; and how many distances were taken."""
    groups = lower.shape[1]
    most = np.array([drift[own == g].max(initial=0) for g in range(groups)])
    cluster, upper, lower = cluster.copy(), upper + drift[cluster], lower - most
    low = lambda rows: lower[rows] * (1 - SLACK) - SLACK
    rows = np.flatnonzero(upper * (1 + SLACK) + SLACK >= low(slice(None)).min(1))
    if not len(rows):
        return cluster, upper, lower, 0
    taken, best = len(rows), np.empty(len(rows), np.int64)
    for j in np.unique(cluster[rows]):
        mine = cluster[rows] == j
        best[mine] = squared(x[rows[mine]], c[[j]])[:, 0]
    upper[rows] = np.sqrt(best)
    old, old_far = cluster[rows].copy(), upper[rows].copy()
    survive = upper[rows][:, None] * (1 + SLACK) + SLACK >= low(rows)
    scans = []
    for g in range(groups):
        at, members = np.flatnonzero(survive[:, g]), np.flatnonzero(own == g)
        if not len(at) or not len(members):
            continue
        d = squared(x[rows[at]], c[members])
        scans.append((g, at, members, d))
        taken += d.size
        nth = d.argmin(1)
        near, name = d[np.arange(len(at)), nth], members[nth]
        better = (near < best[at]) | ((near == best[at]) & (name < cluster[rows[at]]))
        cluster[rows[at[better]]], best[at[better]] = name[better], near[better]
    upper[rows] = np.sqrt(best)
    # Scanned groups: the nearest but the own centroid. Others keep their bound, which the centroid that was left joins.
    for g, at, members, d in scans:
        others = np.where(members[None, :] == cluster[rows[at]][:, None], np.inf, d)
        lower[rows[at], g] = np.sqrt(others.min(1))
    moved = np.flatnonzero(cluster[rows] != old)
    left = own[old[moved]]
    lower[rows[moved], left] = np.minimum(lower[rows[moved], left], old_far[moved])
    return cluster, upper, lower, taken


STATE = "vec_id bigint, v array<int>, cluster int, upper double, lower array<double>, taken long"


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS, width: int = WIDTH, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """The cluster of every vector of vectors (vec_id, embedding) that has `width` components, none null or not finite.

    Components x count as floor(scale * x). The centroids start as the `clusters` vectors with the smallest sha256 of seed:vec_id, in that
    order; equal ids go by their components, null ids come last. A round deals each vector to its nearest centroid, ties to the
    smaller number, and moves the centroids of clusters that are not empty to floor(sum / count); after the rounds all are
    dealt once more. Columns: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. Repeated rows
    each take part. Fewer vectors than clusters: as many clusters. No vectors: no rows. Other columns are
    ignored. Components of 2 ** 27 or more, whose distances 64 bits don't hold, are refused.
    """
    state, centroids = states(vectors, clusters, rounds, groups, width, scale, seed)
    spark = vectors.sparkSession
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = spark.sparkContext.broadcast(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 4096):
            x, own = matrix(b.column(1)).astype(np.int64), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(((x - shared.value[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    found = state.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id bigint, cluster int, distance bigint")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    told = [(j, s, sum(sums.values()), names[j]) for j, s in sums.items()]
    return found.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def states(vectors: DataFrame, clusters: int, rounds: int, groups: int, width: int, scale: float, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors with clusters and bounds after all rounds, taken being the distances of the last one; and the centroids."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size("embedding") == width) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    largest = kept.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    if largest * scale * np.sqrt(width / WIDTH) >= LARGEST:
        raise ValueError(f"components reach {largest}: their distances don't fit into 64 bits")
    kept = kept.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = kept.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()  # a row a cluster
    centroids = np.array([r["v"] for r in picked], np.int64).reshape(len(picked), width)
    if not len(picked):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    own = group(centroids, min(groups, len(centroids)))

    def step(c: np.ndarray, drift: np.ndarray | None):  # noqa: ANN202
        shared = kept.sparkSession.sparkContext.broadcast((c, own, drift))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, own, drift = shared.value
            for b in in_slices(batches, 4096):
                x, taken = matrix(b.column(1)).astype(np.int64), b.num_rows * len(c)
                if drift is None:
                    now, upper, lower = first(x, c, own)
                else:
                    now, upper, lower, taken = again(x, b.column(2).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4)), c, own, drift)
                counts = np.zeros(len(x), np.int64)
                counts[:1] = taken
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(now.astype(np.int32)), pa.array(upper), flat, pa.array(counts)], ["vec_id", "v", "cluster", "upper", "lower", "taken"])

        return run

    state = durable(kept.mapInArrow(step(centroids, None), STATE))
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(width))).collect()  # a row a cluster
        moved = centroids.copy()
        for r in sums:
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(float))
        centroids = moved
        state = durable(state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(step(centroids, drift), STATE))
    return state, centroids


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """SQL of the plain algorithm, a round after the other."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(n - 1 AS INTEGER) AS j, x FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) AS n, x FROM v) WHERE n <= {clusters})""",
    ]
    for t in range(rounds + 1):
        d = f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, j, CAST(d AS BIGINT) AS d FROM (SELECT r, j, d, row_number() OVER (PARTITION BY r ORDER BY d, j) AS n FROM (SELECT v.r, c.j, {d} AS d FROM v, c{t} c)) WHERE n = 1)")
        if t < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            sums = f"SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT a.j, unnest(v.x) AS y, unnest(range(1, {WIDTH + 1})) AS i FROM a{t} a JOIN v USING (r)) GROUP BY j, i"
            parts.append(f"m{t} AS (SELECT j, list({floor} ORDER BY i) AS x FROM ({sums}) GROUP BY j)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (j))")
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT v.vec_id, a.j AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (j)"""
    )


QUERIES = {"op12_yinyang": op12_yinyang}
ORACLES = {"op12_yinyang": oracle()}
