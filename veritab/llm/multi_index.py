"""Embedding near-duplicates with an inverted multi-index (operator 6).

The two halves of normalised vectors have codebooks of their own, fitted on a bounded sample; pairs of codewords form a grid
of cells, and every vector lies in one. A vector visits cells in the order of a bound on how near their vectors can be: a
point that lies in a codeword's region is as far at least as the plane between that codeword and one's own nearest. The
bounds of the halves add up, and a multi-sequence traversal takes cells in the order of the sum. With ``target_recall`` 1
it ends where the sum passes the distance that the threshold allows, so no link is lost; below 1 it ends at the bound that
finds that share of the sample's links. Cells' members are then verified by cosine in double precision.

The index lies by label: a label's cells are cut into groups, in number by how many vectors the label has, and a vector is
sent once to each group that it visits. As the bound holds both ways, it visits only cells from its own on. Groups that hold many
vectors are cut into tiles. Codebooks grow with the largest label, up to a quarter of the sample (``SAMPLE`` vectors of a length,
a documented bound). Equal vectors are one representative with a weight; they are told by value, not by hash.

Defined results: vectors that are null, zero or hold null or non-finite components, those with a null label and rows with a
null vec_id link with nothing (a null id is its own component, kept). Components may have any finite size: vectors are scaled by their
largest before they are squared. Vectors of different lengths don't link; the ``MOST_LENGTHS`` most common lengths have an index, vectors of other
lengths are compared within their label and length, in tiles. Rows that share a vec_id are separate vectors with one component,
and count for each other in n_links if linked. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._components import components
from veritab.llm._session import attach, checkpointed, shuffle_partitions
from veritab.llm.threshold_topk import finite

SAMPLE, ROWS_PER_CELL, TILE, ROWS_PER_GROUP, MOST_LENGTHS = 20_000, 50, 2048, 4096, 4


def normalised(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codebook(rows: np.ndarray, words: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of distinct rows."""
    rows = np.asarray(rows)
    distinct = np.unique(rows, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:words]].copy()
    for _ in range(rounds):
        own = distances(rows, book).argmin(axis=1)
        many = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, rows)
        book[many > 0] = sums[many > 0] / many[many > 0, None]
    return np.unique(book, axis=0)


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (rows * rows).sum(axis=1)[:, None] - 2 * rows @ book.T + (book * book).sum(axis=1))


def bounds(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest codeword, and the least squared distance at which a point of any codeword's region can be."""
    far = distances(rows, book)
    own = far.argmin(axis=1)
    apart = np.sqrt(distances(book, book))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (far - far[np.arange(len(rows)), own][:, None]) / (2 * apart)
    plane[np.arange(len(rows)), own] = 0
    return own, np.maximum(0, np.nan_to_num(plane) - 1e-7) ** 2


def traverse(first: np.ndarray, second: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells (i, j) in ascending order of first[i] + second[j], while that is at most ``most``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap, out = [(x[0] + y[0], 0, 0)], []
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def fronts(first: np.ndarray, second: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells that ``traverse`` visits, for many rows at once: (row, cell), cells by number. Both sequences are ascending, so for each of the first
    the second is read up to a front, which falls as the first rises; rows whose first sequence has ended take no further step."""
    a, b = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    x, y = np.take_along_axis(first, a, axis=1), np.take_along_axis(second, b, axis=1)
    rows, cells = [], []
    live = np.arange(len(first))
    for i in range(first.shape[1]):
        live = live[x[live, i] + y[live, 0] <= most]
        if not len(live):
            break
        reached = y[live] <= (most - x[live, i])[:, None]
        r, j = np.nonzero(reached)
        rows.append(live[r])
        cells.append(a[live[r], i] * second.shape[1] + b[live[r], j])
    row, cell = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*cells, np.zeros(0, np.int64)])
    order = np.lexsort((cell, row))
    return row[order], cell[order]


class MultiIndex:
    """``n_rows``: vectors that the index will hold under one label at most."""

    def __init__(self, sample: np.ndarray, n_rows: int, threshold: float, target_recall: float = 1.0, seed: int = 3):
        rows = normalised(sample)
        self.dims, self.half = rows.shape[1], rows.shape[1] // 2
        words = int(max(1, min(len(rows) / 4, (n_rows / ROWS_PER_CELL) ** 0.5)))
        self.books = codebook(rows[:, : self.half], words, seed), codebook(rows[:, self.half :], words, seed + 1)
        self.most = 2 - 2 * threshold + 1e-9
        if target_recall < 1:
            part = rows[:4000]
            i, j = np.nonzero(np.triu(part @ part.T >= threshold, 1))
            if len(i):
                own, bound = zip(*(bounds(part[:, s], book) for s, book in zip((slice(0, self.half), slice(self.half, None)), self.books, strict=True)), strict=True)
                need = bound[0][i, own[0][j]] + bound[1][i, own[1][j]]
                self.most = min(self.most, float(np.quantile(need, target_recall, method="higher")))

    @property
    def n_cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell; and the cells that rows visit, as pairs (row, cell) in ascending order."""
        rows = normalised(rows)
        (u, x), (v, y) = bounds(rows[:, : self.half], self.books[0]), bounds(rows[:, self.half :], self.books[1])
        return u * len(self.books[1]) + v, *fronts(x, y, self.most)


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return normalised(left) @ normalised(right).T >= threshold


def _least_reached(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that pairs (x, y) of places reach, for both sides."""
    low_p, low_q = p.copy(), q.copy()
    while True:
        before = low_p.copy(), low_q.copy()
        np.minimum.at(low_p, x, low_q[y])
        np.minimum.at(low_q, y, low_p[x])
        if (before[0] == low_p).all() and (before[1] == low_q).all():
            return low_p, low_q


PLACE = ["label", "dims", "g", "r", "q"]


def _tile(rows: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of each tile of a bucket, cell by cell: how many rows link to each vector, and edges that join what the tile's links join. Each link is found once, from the vector whose (cell, gid) comes first."""
    out = []
    at = rows.groupby(PLACE).indices if len(rows) else {}
    for k, own in asked.groupby(PLACE).indices.items() if len(asked) else ():
        if k not in at:
            continue
        x, y = asked.iloc[own], rows.iloc[at[k]]
        y = y.iloc[np.argsort(y.cell.to_numpy(), kind="stable")]
        left, right = (normalised(np.stack(z.vector.to_numpy()).astype(np.float64)) for z in (x, y))
        a, b, home, cell = x.gid.to_numpy(), y.gid.to_numpy(), x.cell.to_numpy(), y.cell.to_numpy()
        visits = np.concatenate(x.cells.to_numpy())
        who = np.repeat(np.arange(len(x)), x.cells.map(len))
        order = np.argsort(visits, kind="stable")
        visits, who = visits[order], who[order]
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        pairs = []
        for i, j in zip(heads, np.append(heads[1:], len(cell)), strict=True):
            asks = who[np.searchsorted(visits, cell[i]) : np.searchsorted(visits, cell[i], "right")]
            if len(asks):
                m, n = np.nonzero(left[asks] @ right[i:j].T >= threshold)
                m, n = asks[m], n + i
                good = (home[m] < cell[i]) | (a[m] < b[n])
                pairs.append((m[good], n[good]))
        m, n = (np.concatenate([z[k] for z in pairs]) for k in (0, 1)) if pairs else (np.zeros(0, np.int64),) * 2
        if not len(m):
            continue
        p, q = x.rep.to_numpy(np.int64), y.rep.to_numpy(np.int64)
        low_p, low_q = _least_reached(p, q, m, n)
        for ids, reps, low, mine, theirs in ((a, p, low_p, m, y.weight.to_numpy()[n]), (b, q, low_q, n, x.weight.to_numpy()[m])):
            many = np.bincount(mine, theirs, len(ids)).astype(np.int64)
            out.append(pd.DataFrame({"gid": ids, "u": reps, "v": low, "n": many})[many > 0])
    return pd.concat(out) if out else pd.DataFrame({"gid": [], "u": [], "v": [], "n": []}, dtype="int64")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, target_recall: float = 1.0, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    attach(spark)
    vector = vectors[vector_col].cast("array<double>")
    able = finite(vector) & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & vectors[label_col].isNotNull() & vectors[id_col].isNotNull()
    able = F.coalesce(able, F.lit(False))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.when(able, vectors[label_col].cast("string")).alias("label"), F.when(able, vectors[vector_col]).alias("vector"))
    rows = checkpointed(rows)
    able = rows.where("label IS NOT NULL")
    reps = able.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dims", F.size("vector"))
    reps = checkpointed(reps.withColumn("gid", F.monotonically_increasing_id()))
    largest = reps.groupBy("dims", "label").count().groupBy("dims").agg(F.max("count").alias("largest"), F.sum("count").alias("total")).orderBy(F.col("total").desc(), "dims").limit(MOST_LENGTHS).collect()
    total, indexes = reps.count(), {}
    for r in largest:
        if r.dims > 1:
            sample = reps.where(F.col("dims") == r.dims).orderBy(F.xxhash64(F.lit(seed), "vector"), "label").limit(SAMPLE).select("vector").toPandas()
            indexes[r.dims] = MultiIndex(np.stack(sample.vector.to_numpy()).astype(np.float64), r.largest, threshold, target_recall, seed)
    held = reps.groupBy("label", "dims").agg(F.ceil(F.count("*") / rows_per_group).cast("long").alias("groups"))
    reps = reps.join(held, ["label", "dims"]).select("label", "dims", "gid", "rep", "weight", "vector", "groups")

    def file(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            cell, asks, g = np.zeros(len(pdf), np.int64), np.empty(len(pdf), object), np.zeros(len(pdf), np.int64)
            for i in range(len(pdf)):
                asks[i] = [{"g": 0, "cells": [0]}]
            for dims, at in pdf.groupby("dims").indices.items():
                if dims not in indexes:
                    continue
                index, groups = indexes[dims], pdf.groups.to_numpy()[at]
                own, row, to = index.cells(np.stack(pdf.vector.iloc[at].to_numpy()).astype(np.float64))
                groups = np.minimum(groups, index.n_cells)
                cell[at], g[at] = own, own * groups // index.n_cells
                later = to >= own[row]
                row, to = row[later], to[later]
                group = to * groups[row] // index.n_cells  # ascends with the cell
                heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
                parts, of = np.split(to, heads[1:]), row[heads]
                cuts = np.searchsorted(of, np.arange(len(at) + 1))
                for i, a, b in zip(at.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    asks[i] = [{"g": int(group[h]), "cells": c} for h, c in zip(heads[a:b].tolist(), parts[a:b], strict=True)]
            yield pdf.drop(columns="groups").assign(cell=cell, g=g, asks=asks)

    schema = "label string, dims int, gid long, rep long, weight long, vector array<" + rows.schema["vector"].dataType.elementType.simpleString() + ">"
    filed = checkpointed(reps.mapInPandas(file, f"{schema}, cell long, g long, asks array<struct<g:long,cells:array<long>>>"))
    mine = filed.drop("asks")
    asked = filed.select("label", "dims", "gid", "rep", "weight", "vector", "cell", F.inline("asks"))
    # A group with many vectors is cut into tiles, and so are those who visit it; every tile of the ones meets every tile of the others.
    place = ["label", "dims", "g"]
    many = lambda side, out: side.groupBy(*place).agg(F.ceil(F.count("*") / tile).cast("int").alias(out))
    tiles = checkpointed(many(mine, "rs").join(many(asked.select(*place), "qs"), place).where("rs > 1 OR qs > 1"))
    buckets = max(shuffle_partitions(spark), total // 5000)
    salt = lambda seed, many: F.pmod(F.xxhash64(F.lit(seed), "gid"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    bucket = F.pmod(F.xxhash64(*place, "r", "q"), F.lit(buckets))
    tiled = lambda side: side.join(tiles, place, "left").withColumns({"rs": F.coalesce("rs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))})
    mine = tiled(mine).withColumn("r", salt(1, "rs")).withColumn("q", every("qs")).withColumn("bucket", bucket).drop("rs", "qs")
    asked = tiled(asked).withColumn("q", salt(2, "qs")).withColumn("r", every("rs")).withColumn("bucket", bucket).drop("rs", "qs")
    asked = asked.toDF(*asked.columns)  # both sides come from one table
    found = checkpointed(mine.toDF(*mine.columns).groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(lambda a, b: _tile(a, b, threshold), "gid long, u long, v long, n long"))
    links = found.groupBy("gid").agg(F.sum("n").alias("far"))
    known = filed.select("label", "vector", "gid", "rep", "weight").join(links, "gid", "left")
    known = checkpointed(able.join(known, ["label", "vector"]).select("vec_id", "rep", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")))
    classes = components(found.select("u", "v").unionByName(known.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))))
    every_row = known.select("vec_id", "n_links").unionByName(rows.where("label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    component = F.coalesce("component", "vec_id")
    return every_row.join(classes, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
