"""Centroid clustering whose assignments are found by the threshold algorithm.

Each dimension keeps its centroids sorted by value. From a vector's value every list is walked outward, always to the nearer of the
next centroid below and the next above. A centroid met for the first time in any list gets its exact distance. Centroids not met
yet are at least as far in every dimension as the list's frontier, so the walk of a vector ends when the sum of the squared
frontier gaps strictly exceeds the best distance: equal distances are still met, and the smaller centroid number wins.

Vectors never move: a round is one pass over them that gives one row of partial sums per centroid and task, combined by Spark to
``k`` times ``dimensions`` exact sums. Only the centroids (``k`` rows, a parameter) are known to the driver and sent to tasks.

Cases: vectors that are null, of another length, or with a null or non-finite component take no part and have no row; repeated ids and equal vectors
are rows of their own; a null id counts as the empty text for the first centroids and stays null; equal hashes are ordered by the components;
fewer vectors than ``k`` give as many centroids; empty centroids stay; an empty table gives an empty result; other columns are not
read, whatever their names. Components are held to +-2**27 after scaling, so that distances fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import stage

LARGEST = 2**27
# Vectors that walk together; their exact distances are computed at once.
TOGETHER = 512


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("bigint")
    kept = vectors.where(v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, finite))
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(v, whole).alias("v"))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of ``x``, by the threshold algorithm."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    sorted_values = np.take_along_axis(centroids, order, axis=0)
    # a place beyond either end of each list, farther than any value
    far = 8 * LARGEST
    values = np.vstack([np.full((1, dims), -far), sorted_values, np.full((1, dims), far)])
    numbers = np.vstack([np.zeros((1, dims), np.int64), order, np.zeros((1, dims), np.int64)])
    column = np.arange(dims)
    best, who = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), k)
    for begin in range(0, len(x), TOGETHER):
        rows = np.arange(begin, min(begin + TOGETHER, len(x)))
        above = np.stack([np.searchsorted(sorted_values[:, d], x[rows, d]) for d in range(dims)], axis=1) + 1
        below = above - 1
        met = np.zeros((len(rows), k), bool)
        for _ in range(k):  # the walk visits every list entry at most once
            here = x[rows]
            down, up = here - values[below, column], values[above, column] - here
            lower = down <= up
            gap, at = np.where(lower, down, up), np.where(lower, below, above)
            found = np.zeros_like(met)
            found[np.arange(len(rows))[:, None], numbers[at, column]] = True
            fresh_row, fresh = np.nonzero(found & ~met)
            met |= found
            exact = np.full(met.shape, np.iinfo(np.int64).max)
            exact[fresh_row, fresh] = ((here[fresh_row] - centroids[fresh]) ** 2).sum(axis=1)
            first = exact.argmin(axis=1)
            least = exact[np.arange(len(rows)), first]
            better = (least < best[rows]) | ((least == best[rows]) & (first < who[rows]))
            best[rows[better]], who[rows[better]] = least[better], first[better]
            below, above = below - lower, above + ~lower
            on = ((gap**2).sum(axis=1) <= best[rows]) & ~met.all(axis=1)
            if not on.any():
                break
            rows, below, above, met = rows[on], below[on], above[on], met[on]
    return who, best


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dimensions)


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of the vectors nearest to each; empty ones as they were."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            who, _ = nearest_centroid(x, centroids)
            np.add.at(sums, who, x)
            counts += np.bincount(who, minlength=k)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = kept.select("v").mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    total = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(exact("n").alias("n"), exact("s").alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k x dimensions rows
        out[r.cluster, r.d] = int(r.s) // int(r.n)
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    ``distance`` is squared; inertia sums it over the cluster and over all. The table is read once for the first centroids, once a round
    and once for the last assignment, which is written to the shared folder.
    """
    spark, kind = vectors.sparkSession, vectors.schema[vec_id].dataType.simpleString()
    kept = whole_vectors(vectors, vec_id, embedding, dimensions, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, best = nearest_centroid(_matrix(batch.column(1), dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])

    assigned = stage(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    named = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
