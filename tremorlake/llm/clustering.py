"""Centroid clustering by a bisector tournament, in integers.

For every pair of centroids i < j the bisector is an integer normal and a
threshold: a vector v is nearer to j than to i exactly if
``2 v.(cj - ci) - (|cj|^2 - |ci|^2)`` is positive.  A vector's nearest centroid
is the winner of k - 1 such sign tests (the winner so far against the next
number; zero keeps the smaller number); only the winner's distance is computed.

The vectors are written once as integers.  A round is one pass over them: a
task keeps one count and one sum vector per cluster, which Spark adds up, so
k * dims sums reach the driver whatever the table's size.  Centroids are sums
floor-divided by counts, so results do not depend on partitions or retries.

Defined results: rows whose vector is NULL, has another number of components,
or a null, NaN or infinite component take no part and are not returned; a row
with a NULL id is clustered, but starts a centroid only if the others are too
few; repeated rows count as often as they are there; of equal start hashes the
smaller vector comes first; fewer rows than k make as many centroids; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import slices, written
from tremorlake.llm.vectors import floored, matrix, usable


@dataclass
class Clustering:
    """``vectors``: (vec_id, cluster, distance); ``clusters``: (cluster, centroid, n, inertia), one row a centroid."""

    vectors: DataFrame
    clusters: DataFrame


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, v: np.ndarray) -> np.ndarray:
        won = np.zeros(len(v), dtype=np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", v, self.normals[won, j]) - self.thresholds[won, j]
            won[side > 0] = j
        return won

    def distances(self, v: np.ndarray, won: np.ndarray) -> np.ndarray:
        apart = v - self.centroids[won]
        return np.einsum("nd,nd->n", apart, apart)


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Per non-empty cluster: its number of vectors and their componentwise sum."""
    bisectors, (k, dims) = Bisectors(centroids), centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for b in slices(batches, 4096):
            v = matrix(b.column(0), dims)
            won = bisectors.winners(v)
            count += np.bincount(won, minlength=k)
            np.add.at(total, won, v)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(held, pa.int32()), "n": pa.array(count[held], pa.int64()),
                                          "total": pa.array(list(total[held]), pa.list_(pa.int64()))})

    parts = vectors.select("v").mapInArrow(part, "cluster int, n long, total array<bigint>")
    whole = (parts.select("cluster", "n", F.posexplode("total").alias("pos", "x"))
             .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in whole.collect():  # k * dims rows
        _, vector = out.setdefault(r["cluster"], (r["n"], np.zeros(dims, dtype=np.int64)))
        vector[r["pos"]] = r["x"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    bisectors, dims = Bisectors(centroids), centroids.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            v = matrix(b.column(1), dims)
            won = bisectors.winners(v)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "cluster": pa.array(won, pa.int32()),
                                              "distance": pa.array(bisectors.distances(v, won), pa.int64())})

    return vectors.select("vec_id", "v").mapInArrow(part, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024,
            seed: int = 3) -> Clustering:
    """Cluster ``rows(vec_id, embedding)`` around ``k`` integer centroids.

    Components become floor(scale * x).  ``rounds`` times every vector goes to
    its nearest centroid and every non-empty centroid becomes the floor of its
    vectors' mean; then vectors are assigned once more.
    """
    spark = rows.sparkSession
    kept = rows.filter(usable(F.col("embedding")) & (F.size("embedding") == dims))
    vectors = written(kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                                  floored(F.col("embedding"), scale).alias("v")), "cluster-vectors")
    centroids = start(vectors, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"),
                          spark.createDataFrame([], "cluster int, centroid array<bigint>, n long, inertia long"))
    for _ in range(rounds):
        for c, (n, total) in sums(vectors, centroids).items():
            centroids[c] = total // n  # numpy's integer division of a positive count is floor
    result = written(assigned(vectors, centroids), "cluster-assigned")
    table = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)],
                                  "cluster int, centroid array<bigint>")
    filled = result.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"))
    zero = F.lit(0).cast("long")
    clusters = (table.join(filled, "cluster", "left")
                .withColumns({"n": F.coalesce("n", zero), "inertia": F.coalesce("inertia", zero)}))
    return Clustering(result, clusters)


def digest(centroid: list[int]) -> str:
    """sha256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
