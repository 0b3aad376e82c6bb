"""Vector code compression by Hamerly's bounds over Lloyd's rounds (operator 12).

Vectors become integers floor(scale * x) and are cut into equal consecutive parts, each with a codebook of its own. A row
keeps, for each of its parts, the entry it is assigned to, an upper bound of the distance to it and a lower bound of the
distance to the second-nearest entry; these are persisted with the row from round to round. When entries move, the upper
bound grows by the move of the part's own entry and the lower one falls by the largest move of the others. As long as the
upper bound is strictly less than the lower one, or than half the distance from the entry to the entry nearest to it, no
other entry can be as near, so the assignment stands, ties included. Else the distance to the own entry is taken anew, and
only where that doesn't restore the strict order all entries are scanned in exact integers (``_exact``), the lower
index winning ties. Bounds are doubles, rounded away from each other at every step, so rounding never hides a tie.

Rows go from round to round in place: no shuffle. Entries' sums are joined by ``treeAggregate``. The persisted rows have
narrow lineage to the table, so what a lost executor held is computed again from its own rows alone.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Vectors of different lengths
have codebooks of their own, trained side by side; such whose length the number of parts doesn't divide are filled with zeros
at the end. An entry is a row: of the rows that share an id those with the least components come first, rows
with a null id last; with fewer than 256 rows there are as many entries. Repeated rows are rows of their own. An error that
a 64-bit integer can't hold is null, and so are sums with one. Empty vectors have the first entries' codes and no error. An
empty table gives no rows. Columns beside the id, the vector and the label don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import _exact
from veritab.llm._session import attach, checkpointed
from veritab.llm.threshold_topk import finite

#: Up to so many labels their sums are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000

STATE = "vec_id long, label {label}, vector array<double>, code binary, upper array<double>, lower array<double>, scans int"


@dataclass
class Book:
    """The entries of one part, and what a round needs to know of their last moves."""

    entries: np.ndarray

    def __post_init__(self):
        self.exact = bool(_exact.plain(self.entries).all())
        self.moves = self.others = None
        self.half = np.zeros(len(self.entries))
        if self.exact and len(self.entries) > 1:
            apart = _exact.distances(self.entries, self.entries).astype(np.float64)
            np.fill_diagonal(apart, np.inf)
            self.half = _down(_down(np.sqrt(apart.min(axis=1))) / 2)

    def moved(self, entries: np.ndarray) -> Book:
        """The book with new entries: how far each moved, and how far any other did at most."""
        book = Book(entries)
        if self.exact and book.exact:
            book.moves = _up(np.sqrt(_exact.to_points(self.entries, entries).astype(np.float64)))
            book.moves[(self.entries == entries).all(axis=1)] = 0
            order = np.argsort(-book.moves, kind="stable")
            book.others = np.full(len(entries), book.moves[order[0]])
            book.others[order[0]] = book.moves[order[1]] if len(order) > 1 else 0
        return book


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def reassigned(rows: np.ndarray, book: Book, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Assignments and bounds of the rows of one part after its book moved, and which rows were scanned. Without a code all are."""
    n = len(rows)
    if code is None or book.moves is None:
        code, upper, lower, scan = np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf), np.ones(n, bool)
    else:
        code, upper, lower = code.astype(np.int64), _up(upper + book.moves[code]), _down(lower - book.others[code])
        bound = np.maximum(lower, book.half[code])
        loose = np.flatnonzero(~(upper < bound))
        upper[loose] = _roots(_exact.to_points(rows[loose], book.entries[code[loose]]), _up)
        scan = np.zeros(n, bool)
        scan[loose[~(upper[loose] < bound[loose])]] = True
    if scan.any():
        apart = _exact.distances(rows[scan], book.entries)
        at = np.argmin(apart, axis=1)
        code[scan], every = at, np.arange(len(at))
        safe = book.exact & _exact.plain(rows[scan])
        upper[scan] = np.where(safe, _roots(apart[every, at], _up), np.inf)
        if apart.shape[1] > 1:
            rest = apart.copy()
            rest[every, at] = rest.max() + 1 if len(rest) else 0
            lower[scan] = np.where(safe, _roots(rest.min(axis=1), _down), -np.inf)
        else:
            lower[scan] = np.inf
    return code, upper, lower, scan


def _roots(squares: np.ndarray, away) -> np.ndarray:
    """Bounds of square roots; zero stays zero upwards, so equal vectors are told from near ones."""
    if squares.dtype == object:
        squares = np.array([float(x) if x < 1 << 1000 else np.inf for x in squares])
    roots = np.sqrt(squares.astype(np.float64))
    return np.where(roots == 0, 0.0, away(roots)) if away is _up else away(roots)


def parts_of(values: np.ndarray, scale: int, parts: int) -> list[np.ndarray]:
    """The integers of vectors of one length, cut into parts."""
    rows = _exact.whole(values, scale)
    if short := -rows.shape[1] % parts:
        rows = np.concatenate([rows, np.zeros((len(rows), short), rows.dtype)], axis=1)
    return np.split(rows, parts, axis=1)


def _step(batches: Iterator[pa.RecordBatch], books: dict[int, list[Book]], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, at, values in _exact.by_length(batch.column("vector")):
            part, rows = batch.take(pa.array(at)), parts_of(values, scale, len(books[n]))
            many = len(rows)
            known = part.column("code").null_count == 0
            if known:
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, many)
                upper, lower = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, many) for c in ("upper", "lower"))
            new = [reassigned(rows[p], books[n][p], *((code[:, p], upper[:, p].copy(), lower[:, p].copy()) if known else (None, None, None))) for p in range(many)]
            codes, uppers, lowers, scans = (np.stack([x[i] for x in new], axis=1) for i in range(4))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, many, dtype=np.int32)), pa.array(x.astype(np.float64).ravel()))
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            counted = pa.array(part.column("scans").to_numpy(zero_copy_only=False) + scans.sum(axis=1), pa.int32())
            columns = [part.column("vec_id"), part.column("label"), part.column("vector"), packed, lists(uppers), lists(lowers), counted]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector", "code", "upper", "lower", "scans"])


def _totals(state: DataFrame, books: dict[int, list[Book]], scale: int) -> dict[int, list[tuple]]:
    """By length and part: counts and sums of the rows assigned to each entry."""

    def fold(batches: Iterator[pa.RecordBatch]) -> dict:
        out: dict[int, list[tuple]] = {}
        for batch in batches:
            for n, at, values in _exact.by_length(batch.column("vector")):
                rows = parts_of(values, scale, len(books[n]))
                code = np.frombuffer(b"".join(batch.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, len(rows))
                found = {n: [_exact.sums(rows[p], code[:, p], len(books[n][p].entries)) for p in range(len(rows))]}
                out = merge(out, found)
        return out

    def merge(a: dict, b: dict) -> dict:
        joined = {n: [tuple(x + y for x, y in zip(s, t, strict=True)) for s, t in zip(a[n], b[n], strict=True)] for n in a.keys() & b.keys()}
        return {**a, **b, **joined}

    return _exact.gathered(state.select("vector", "code"), fold, merge)


def trained(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, list[Book]], DataFrame | None]:
    """The rows with codes under the final books (vec_id, label, vector, code, bounds, scans: whole scans so far), these books by length of vectors, and the last round's persisted rows, to unpersist when the first are used."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    attach(vectors.sparkSession)
    vector = vectors[vector_col].cast("array<double>")
    rows = vectors.where(finite(vector)).select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vector.alias("vector"))
    schema = STATE.format(label=rows.schema["label"].dataType.simpleString())
    starts = _exact.first_rows(rows.select("vec_id", "vector"), entries)
    books = {n: [Book(e) for e in parts_of(np.array(v, np.float64).reshape(len(v), n), scale, parts)] for n, v in starts.items()}
    empty = F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<double>").alias("upper"), F.lit(None).cast("array<double>").alias("lower"), F.lit(0).alias("scans")
    state, before = rows.select("*", *empty), None
    for k in range(rounds + 1):
        state = state.mapInArrow(lambda batches, books=books: _step(batches, books, scale), schema)
        if k < rounds:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            found = _totals(state, books, scale)
            books = {n: [book.moved(_exact.means(book.entries, *found[n][p])) for p, book in enumerate(of)] for n, of in books.items()}
            if before is not None:
                before.unpersist()
            before = state
    return state, books, before


def digest(books: list[Book]) -> str:
    """The sha256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book.entries.tolist() for x in entry).encode()).hexdigest()


def codes(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    state, books, before = trained(vectors, entries, rounds, parts, scale, id_col, vector_col, label_col)
    digests = {n: digest(of) for n, of in books.items()}

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, values in _exact.by_length(batch.column("vector")):
                part, rows = batch.take(pa.array(at)), parts_of(values, scale, parts)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                error = sum(_exact.to_points(rows[p], books[n][p].entries[code[:, p]]).astype(object) for p in range(parts))
                named = pa.array([digests[n]] * len(at), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), _exact.longs(error), named], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = state.schema["label"].dataType.simpleString()
    done = checkpointed(state.mapInArrow(errors, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"))
    if before is not None:
        before.unpersist()
    known = F.count("*") == F.count("error")
    total = F.when(known, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    by_label = checkpointed(done.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    return done.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
