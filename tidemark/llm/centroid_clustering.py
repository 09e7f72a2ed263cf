"""Integer k-means whose assignment is an equal-average equal-variance search.

Components are turned into integers, ``floor(scale * x)``, and everything
that decides is computed on integers, so results don't depend on how Spark
deals the rows out.

Assignment of a vector x of d components, with sum S and deviation
V = sqrt(sum((x_i - mean)^2)): centroids are sorted by their component mean
(by S, as all have d components).  The search starts where x's own mean would
stand and goes outward, always to the side whose mean is nearer.  Since

    |x - c|^2  >=  (S_x - S_c)^2 / d  +  (V_x - V_c)^2,

the first centroid whose first term exceeds the best distance so far ends the
search (all others are farther off on either side), and one for which both
terms exceed it is passed over.  What remains is compared by exact integer
distance; ties go to the smaller number.  The bounds are computed in doubles
and lowered by more than their rounding error, so they never reject a nearest
centroid.

A round is one pass over the written integer vectors: each task adds up its
clusters, Spark adds the tasks' sums, and k * d sums come to the driver.  No
cluster is ever a group, so a hot one doesn't matter.  Rounds end early when
no centroid moves, which leaves the result as it is.

Vectors that are null, of another length, or that hold null or non-finite
components take no part; nor do those with an integer component of
``2 ** 27`` or more in size, whose distance has no place in 64 bits.  Rows
that repeat an id are vectors of their own.  A row without an id is clustered
like any other and starts a cluster only where too few others exist.  Fewer
vectors than clusters: as many centroids as vectors.  An empty table gives
an empty result.  Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_to_table
from .vector_blocks import finite

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"
LARGEST = 1 << 27
#: Rows of a batch that are searched at once; bounds the temporary arrays.
ROWS_AT_ONCE = 8192


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): vectors that take part, as integers."""
    scaled = F.col("x").cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("x")) \
        .where(F.col("x").isNotNull() & (F.size("x") == dimensions) & finite(scaled)) \
        .select("id", F.transform(scaled, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    return rows.where(F.forall("v", lambda x: (x < LARGEST) & (x > -LARGEST))) \
        .select("id", F.col("v").cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, k rows in all."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def _deviation(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - x.mean(axis=1, keepdims=True)).sum(axis=1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance for each row of ``x`` (both int64)."""
    (n, d), k = x.shape, len(centroids)
    totals = centroids.sum(axis=1)
    order = np.argsort(totals, kind="stable")
    means, sorted_centroids, deviations = totals[order], centroids[order], _deviation(centroids)[order]
    own, spread = x.sum(axis=1), _deviation(x)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    above = np.searchsorted(means, own)
    below = above - 1
    rows = np.arange(n)
    while len(rows):
        lo, hi = below[rows], above[rows]
        gap_lo = np.where(lo >= 0, own[rows] - means[np.maximum(lo, 0)], np.inf)
        gap_hi = np.where(hi < k, means[np.minimum(hi, k - 1)] - own[rows], np.inf)
        down = gap_lo <= gap_hi
        by_mean = np.square(np.minimum(gap_lo, gap_hi)) / d * (1 - 1e-9)
        is_open = by_mean <= best[rows]  # an infinite gap: both sides are used up
        is_open &= np.isfinite(by_mean)
        rows, down, by_mean = rows[is_open], down[is_open], by_mean[is_open]
        at = np.where(down, lo[is_open], hi[is_open])
        below[rows[down]] -= 1
        above[rows[~down]] += 1

        apart = np.abs(spread[rows] - deviations[at])
        apart = np.maximum(apart - 1e-9 * (spread[rows] + deviations[at]) - 1e-3, 0)
        close = by_mean + np.square(apart) * (1 - 1e-9) <= best[rows]
        near, at = rows[close], at[close]
        difference = x[near] - sorted_centroids[at]
        distance, number = np.einsum("ij,ij->i", difference, difference), order[at]
        better = (distance < best[near]) | ((distance == best[near]) & (number < who[near]))
        best[near[better]], who[near[better]] = distance[better], number[better]
    return who, best


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(start, ROWS_AT_ONCE)
        flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
        yield part.column("id"), flat.astype(np.int64).reshape(part.num_rows, d)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, d = centroids.shape

    def add_up(batches):
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64)
        for batch in batches:
            for _, x in _matrices(batch, d):
                who, _ = nearest(x, centroids)
                counts += np.bincount(who, minlength=k)
                np.add.at(sums, who, x)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    wide = "decimal(38,0)"
    sums = rows.mapInArrow(add_up, "cluster int, n long, total array<long>") \
        .select("cluster", "n", F.posexplode("total").alias("at", "total")) \
        .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast(wide)).alias("total"))
    moved = centroids.copy()
    for r in sums.collect():  # k * d rows
        moved[r.cluster, r.at] = int(r.total) // r.n
    return moved


def fit(rows: DataFrame, k: int, rounds: int, seed: str) -> np.ndarray:
    """Final centroids of written integer vectors (id, v)."""
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = _moved(rows, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each row of integer vectors."""
    d = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            for ids, x in _matrices(batch, d):
                who, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])

    return rows.mapInArrow(assign, "id long, cluster int, distance long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = CLUSTERS,
            rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    spark = vectors.sparkSession
    rows = cut_to_table(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "cluster-vectors")
    centroids = fit(rows, k, rounds, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    found = cut_to_table(assigned(rows, centroids), "cluster-assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r.cluster: int(r.s) for r in sums.collect()}  # k rows
    whole = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame(
        [(i, inertia[i], whole, digest[i]) for i in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
