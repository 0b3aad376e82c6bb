"""Exact top-k by sequential reading of sorted lists, without random access (operator 2).

Rows are dealt to blocks; a block holds its rows' components as one sorted list a dimension. For a query, lists are read
from the end where products are largest, those of its largest components first and deepest: as many lists again are read
down to where products stop being positive (what is left of them adds nothing to a score), lists before those are
read to their end, lists behind it not at all. What was read of a row bounds its score from both sides: the unread
rest is at most the product of the norms of what is unread of the query and of the row, and the latter is the row's norm
without the components read. Reading stops when few enough rows can still reach the k-th lower bound, whatever the others
hold; the contenders' final scores are then resolved. The k-th score of a query in the first block is carried into all
others, so there reading stops earlier and only rows that reach it are returned. Blocks' results are merged.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
padded with zeros. Rows with the query's id are never its candidates; repeated rows are candidates of their own; of
repeated query ids the least vector asks. Rows with a null id take no part. An empty table gives no rows. Scores are
64-bit integers: components of the scaled vectors must stay under 2**31 for them not to wrap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._session import attach, checkpointed

ROWS_PER_BLOCK, QUERIES_PER_CHUNK = 8192, 16384
#: Lists read to their end between two looks at the bounds.
STRIDE = 4


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class SortedLists:
    """The rows of a block: ids, components, and for each dimension the rows in ascending order of it. ``read``, ``held``: entries read so far for all queries, and those that all lists hold."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.most = max(1, int(np.abs(self.rows).max(initial=1)))
        exact = self.most < 1 << 31 and self.most**2 * self.rows.shape[1] < 1 << 53
        self.whole = self.rows.astype(np.float64) if exact else self.rows
        scaled = (self.rows.T / self.most).astype(np.float32)
        at = np.argsort(scaled, axis=1, kind="stable")
        self.order, self.sorted = at.astype(np.intp), np.take_along_axis(scaled, at, axis=1)
        self.squares = self.sorted * self.sorted
        self.below, self.above = (self.sorted < 0).sum(axis=1), (self.sorted <= 0).sum(axis=1)
        self.norms = (scaled.astype(np.float64) ** 2).sum(axis=0)
        self.read = self.held = 0

    def top(self, query_id: int, query: np.ndarray, k: int, bound: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the best k rows with another id, ties to the smaller id; only those whose score is ``bound`` at least."""
        n = len(self.ids)
        size = max(1, int(np.abs(query).max(initial=1)))
        scaled = query / size
        lists = np.argsort(-np.abs(scaled), kind="stable")
        lists = lists[: int((scaled != 0).sum())]
        other = self.ids != query_id
        want = min(k, int(other.sum()))
        if want <= 0:
            return []
        unit, slack = float(self.most) * float(size), 1e-5 * (float((scaled**2).sum()) * float(self.norms.max(initial=0))) ** 0.5 + 1e-12
        least = -np.inf if bound is None else bound / unit
        rest = np.sqrt(np.append(np.cumsum((scaled[lists] ** 2)[::-1])[::-1], 0.0))
        part, gone = np.zeros(n, np.float32), np.zeros(n, np.float32)
        dims, full, half = len(lists), 0, 0

        def take(j: int, begin: int, end: int) -> None:
            rows = self.order[j, begin:end]
            part[rows] += self.sorted[j, begin:end] * np.float32(scaled[j])
            gone[rows] += self.squares[j, begin:end]
            self.read += end - begin

        rivals = np.flatnonzero(other)
        self.held += n * dims
        while full < dims:
            # The window moves on: the positive products of lists that enter it, the rest of lists that leave it.
            while half < min(dims, 2 * (full + STRIDE)):
                j, half = lists[half], half + 1
                take(j, *((self.above[j], n) if scaled[j] > 0 else (0, self.below[j])))
            for j in lists[full : full + STRIDE]:
                take(j, *((0, self.above[j]) if scaled[j] > 0 else (self.below[j], n)))
            full = min(dims, full + STRIDE)
            left = np.sqrt(np.maximum(0, self.norms - gone) + slack)
            low = part - (left * rest[full] + slack)
            low[~other] = -np.inf
            least = max(least, float(np.partition(low, n - want)[n - want]))
            high = part + left * rest[half] + slack
            if bound is None and (high >= least).sum() > max(8 * k, n // 8):  # scores of the rows that look best are lower bounds too
                best = np.argpartition(np.where(other, part, -np.inf), n - want)[n - want :]
                least = max(least, float(self._scores(best, query).min()) / unit)
                self.read += want * (dims - full)
            rivals = np.flatnonzero((high >= least - slack) & other)
            if len(rivals) <= max(8 * k, n // 8):
                break
        self.read += len(rivals) * (dims - full)
        score = self._scores(rivals, query)
        best = np.lexsort((self.ids[rivals], -score))[:want]
        return [(i, s) for i, s in zip(self.ids[rivals[best]].tolist(), score[best].tolist(), strict=True) if bound is None or s >= bound]

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        small = self.whole.dtype == np.float64 and float(np.abs(query).max(initial=0)) * self.most * len(query) < 1 << 53
        return (self.whole[rows] @ query.astype(np.float64)).astype(np.int64) if small else self.rows[rows] @ query


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(rows: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(asked):
        dims = max(1, *rows.vector.map(len), *asked.vector.map(len))
        lists = SortedLists(rows.vec_id.to_numpy(np.int64), _matrix(rows.vector, dims))
        bounds = [None if pd.isna(b) else int(b) for b in asked.bound]
        for query_id, query, bound in zip(asked.vec_id.tolist(), _matrix(asked.vector, dims), bounds, strict=True):
            out += [(query_id, i, s) for i, s in lists.top(query_id, query, k, bound)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (a condition on the output column vec_id), the k others with the highest integer inner product of floor(scale * x)."""
    attach(vectors.sparkSession)
    vector = F.transform(vectors[vector_col].cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    known = vectors.where(finite(vectors[vector_col].cast("array<double>")) & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), vector.alias("vector"))
    known = checkpointed(known)
    asked = known.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, m = known.count(), asked.count()
    blocks, chunks = max(1, -(-n // rows_per_block)), max(1, -(-m // QUERIES_PER_CHUNK))
    spread = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "vector"), F.lit(many))
    dealt = known.withColumn("block", spread(1, blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def searched(rows: DataFrame, queries: DataFrame, first: int, last: int) -> DataFrame:
        """Each block of rows meets each chunk of queries."""
        queries = queries.withColumn("chunk", spread(2, chunks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
        return rows.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")

    found = searched(dealt.where("block = 0"), asked.withColumn("bound", F.lit(None).cast("long")), 0, 0)
    if blocks > 1:
        found = checkpointed(found)
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        bounded = checkpointed(asked.join(kth.withColumnRenamed("query_id", "_q"), F.col("vec_id") == F.col("_q"), "left").drop("_q"))
        found = found.unionByName(searched(dealt.where("block > 0"), bounded, 1, blocks - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
