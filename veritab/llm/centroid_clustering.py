"""Centroid clustering with exact integer arithmetic (operator 11).

Vectors become integers floor(scale * x). Each round assigns every vector to its nearest centroid, by matrix products whose
magnitude bounds keep them exact in float64 (``_exact``), with integers where the bounds fail; each partition adds up its
counts, sums and distances, and ``treeAggregate`` joins the partitions' sums on the executors. So a round moves
k x (dims + 2) integers a partition, whatever the number of vectors, and vectors themselves are never shuffled: each
round reads them anew from their table. No key is grouped, so equal vectors in any number share no task.

Defined results: only vectors of exactly ``dims`` components take part, none of them null or non-finite. The first
centroids are the k vectors of the smallest hashes; rows that share an id share a hash and go by components, rows with a null id come last.
With fewer than k vectors there are as many centroids. Repeated rows are vectors of their own. Equal centroids leave all
vectors to the one with the smaller number. Distances that a 64-bit integer can't hold are null, and so are sums
with such. An empty table gives no rows. Columns beside the id and the vector don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import _exact
from veritab.llm._session import attach
from veritab.llm.threshold_topk import finite


@dataclass
class Clustering:
    """The centroids, and of each the vectors that are nearest to it: how many, and the sum of their squared distances."""

    centroids: np.ndarray
    counts: list[int]
    inertia: list[int]
    scale: int


def kept(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = vectors[vector_col].cast("array<double>")
    return vectors.where(finite(vector) & (F.size(vector) == dims)).select(vectors[id_col].cast("long").alias("vec_id"), vector.alias("vector"))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid's number, ties to the smaller, and its squared distance."""
    apart = _exact.distances(rows, centroids)
    at = np.argmin(apart, axis=1)
    return at, apart[np.arange(len(rows)), at]


def totals(frame: DataFrame, centroids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and summed squared distances of the vectors nearest to each centroid."""
    many, dims = centroids.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> tuple:
        counts, total, inertia = np.zeros(many, object), np.zeros((many, dims), object), np.zeros(many, object)
        for batch in batches:
            for _, _, values in _exact.by_length(batch.column("vector")):
                rows = _exact.whole(values, scale)
                at, apart = nearest(rows, centroids)
                n, s = _exact.sums(rows, at, many)
                counts, total, inertia = counts + n, total + s, inertia + _exact.sums(apart[:, None], at, many)[1][:, 0]
        return counts, total, inertia

    return _exact.gathered(frame, fold, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """Lloyd's rounds from seeded centroids. ``scale`` is a power of two."""
    attach(vectors.sparkSession)
    rows = kept(vectors, dims, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = _exact.first_rows(rows.select(hashed.alias("key"), "vector"), k).get(dims, [])
    centroids = _exact.whole(np.array(starts, np.float64).reshape(len(starts), dims), scale)
    if not len(centroids):
        return Clustering(centroids, [], [], scale)
    for _ in range(rounds):
        counts, total, _ = totals(rows, centroids, scale)
        centroids = _exact.means(centroids, counts, total)
    counts, _, inertia = totals(rows, centroids, scale)
    return Clustering(centroids, [int(n) for n in counts], [int(x) for x in inertia], scale)


def assign(vectors: DataFrame, clustering: Clustering, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance of every vector that takes part."""
    attach(vectors.sparkSession)
    centroids, scale = clustering.centroids, clustering.scale

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, values in _exact.by_length(batch.column("vector")):
                at, apart = nearest(_exact.whole(values, scale), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(at, pa.int32()), _exact.longs(apart)], ["vec_id", "cluster", "distance"])

    return kept(vectors, centroids.shape[1], id_col, vector_col).mapInArrow(assigned, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found = fit(vectors, k, rounds, dims, scale, seed, id_col, vector_col)
    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    of_cluster = lambda values, kind: F.array(*values).cast(f"array<{kind}>")[F.col("cluster")]
    return assign(vectors, found, id_col, vector_col).select(
        "vec_id", "cluster", "distance", of_cluster([fits(x) for x in found.inertia], "long").alias("cluster_inertia"), fits(sum(found.inertia)).alias("inertia"), of_cluster([F.lit(x) for x in digests], "string").alias("centroid_sha256")
    )
