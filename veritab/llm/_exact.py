"""Exact squared distances between integer vectors, and states that Spark folds over a table.

Distances come from |x|^2 - 2 x.c + |c|^2 as blocked float64 matrix products. A vector is *plain* if four times its
dimension times the square of its largest component stays below 2**53: then no term and no partial sum of a product of two
plain vectors reaches 2**53, so float64 holds each of them exactly, in whatever order BLAS adds. All other pairs are
taken in 64-bit integers, and those too large for these in Python's.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

#: Rows of one matrix product.
BLOCK = 4096


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every double x: 64-bit integers, or Python's where these are too small. ``scale`` is a power of two, so products are exact."""
    if float(np.abs(values).max(initial=0)) * scale < 1 << 62:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return out


def plain(rows: np.ndarray) -> np.ndarray:
    """Of each vector, whether float64 holds all terms of its distances to other such vectors."""
    if not rows.shape[1]:
        return np.ones(len(rows), bool)
    return (np.abs(rows).max(axis=1) <= math.isqrt(((1 << 53) - 1) // (4 * rows.shape[1]))).astype(bool)


def _integers(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same distances by subtraction, in 64-bit integers if they hold them."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(points).max(initial=0)))
    kind = np.int64 if 4 * max(1, rows.shape[1]) * most * most < 1 << 63 else object
    rows, points, out = rows.astype(kind), points.astype(kind), np.zeros((len(rows), len(points)), kind)
    for j, point in enumerate(points):
        apart = rows - point
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(row, point): squared distances, exact; 64-bit integers, or Python's where one of them needs it."""
    near, close = plain(rows), plain(points)
    out = np.zeros((len(rows), len(points)), np.int64)
    x, c = rows[near].astype(np.float64), points[close].astype(np.float64)
    at, to, norms = np.flatnonzero(near), np.flatnonzero(close), (c * c).sum(axis=1)
    for i in range(0, len(x), BLOCK):
        block = x[i : i + BLOCK]
        out[np.ix_(at[i : i + BLOCK], to)] = (block * block).sum(axis=1)[:, None] - 2 * (block @ c.T) + norms
    for some, others in ((np.flatnonzero(~near), np.arange(len(points))), (at, np.flatnonzero(~close))):
        if len(some) and len(others):
            found = _integers(rows[some], points[others])
            out = out.astype(object) if found.dtype == object else out
            out[np.ix_(some, others)] = found
    return out


def to_points(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The squared distance of each row to the point of the same place."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(points).max(initial=0)))
    kind = np.int64 if 4 * max(1, rows.shape[1]) * most * most < 1 << 63 else object
    apart = rows.astype(kind) - points.astype(kind)
    return (apart * apart).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), kind)


def sums(rows: np.ndarray, at: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the rows of each number, as Python integers, which never wrap."""
    counts, total = np.bincount(at, minlength=many).astype(object), np.zeros((many, rows.shape[1]), object)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    if len(used):
        small = rows.dtype != object and int(np.abs(rows).max(initial=0)) * len(rows) < 1 << 62
        total[used] = np.add.reduceat(rows[order] if small else rows[order].astype(object), first, axis=0).astype(object)
    return counts, total


def means(points: np.ndarray, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each point that has rows; others stay."""
    moved = [[int(s) // n for s in row] if n else point for point, n, row in zip(points.tolist(), counts.tolist(), total, strict=True)]
    return held(moved, points.shape[1])


def held(rows: list, dims: int) -> np.ndarray:
    """Rows of Python integers as an array, of 64 bits if all of them fit."""
    small = all(-(1 << 62) < x < 1 << 62 for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), dims)


def longs(values: np.ndarray) -> pa.Array:
    """A column of 64-bit integers; such as need more are null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if abs(x) < 1 << 63 else None for x in values], pa.int64())


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, values): the vectors of a batch as one matrix of doubles for each length there is."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        same = column if len(rows) == len(lengths) else column.take(pa.array(rows))
        yield n, rows, same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)


def gathered(frame: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """One state of a whole table: ``fold`` makes one of each partition's batches, ``merge`` joins two, in a tree on the executors, so the driver sees a few states of bounded size. ``fold`` of no batches is the neutral state."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(fold(batches))], pa.binary())})

    return frame.mapInArrow(folded, "state binary").rdd.map(lambda row: pickle.loads(row.state)).treeAggregate(fold(iter(())), merge, merge)


def first_rows(frame: DataFrame, many: int) -> dict[int, list[tuple]]:
    """Of a table (key, vector), for each length of vectors the vectors of the ``many`` smallest keys, ascending; ties go by components, null keys come last."""

    def fold(batches: Iterator[pa.RecordBatch]) -> dict:
        best: dict[int, list] = {}
        for batch in batches:
            for n, rows, _ in by_length(batch.column(1)):
                part = batch.take(pa.array(rows))
                order = pc.sort_indices(part.column(0))
                if len(order) > many and (last := part.column(0)[order[many - 1].as_py()]).is_valid:
                    order = order[: pc.sum(pc.less_equal(part.column(0), last)).as_py()]
                found = part.take(order)
                best[n] = heapq.nsmallest(many, [*best.get(n, []), *(((k is None, 0 if k is None else k), tuple(v)) for k, v in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))])
        return best

    def merge(a: dict, b: dict) -> dict:
        return {n: heapq.nsmallest(many, [*a.get(n, []), *b.get(n, [])]) for n in a.keys() | b.keys()}

    return {n: [v for _, v in rows] for n, rows in gathered(frame, fold, merge).items()}
