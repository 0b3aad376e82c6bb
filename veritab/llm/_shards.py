"""Documents as compressed shards of a few megabytes, which later passes hand to numpy whole.

A shard holds documents in the order of their id (nulls first): one row with the zstd-compressed bytes of their texts.
Shards are written once, to the checkpoint folder, so that passes over them agree whatever executors are lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._session import attach, checkpointed

SHARD_BYTES = 4 << 20
NULL_ID = -(1 << 63)
SCHEMA = "shard_id long, n_docs long, n_bytes long, payload binary"


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


@dataclass
class Shard:
    """``text``: the documents' bytes, end to end; document i has bytes ``ends[i - 1]`` to ``ends[i]``. A null id is NULL_ID."""

    shard_id: int
    ids: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, shard_id: int, payload: bytes) -> Shard:
        ids, ends, text = unpack(payload)
        return cls(int(shard_id), ids, ends, np.frombuffer(text, np.uint8))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def runs(self, size: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``size`` bytes, which stay in a CPU's cache."""
        first = 0
        while first < len(self.ids):
            begin = self.ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(self.ends, begin + size)))
            yield first, min(last, len(self.ids))
            first = last


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined bytes of an Arrow column of strings; null: empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.diff(offsets), data


def _split(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        size, data = texts_of(batch.column(1))
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(begin, begin[first] + shard_bytes)))
            last = min(last, len(ids))
            order = first + np.argsort(ids[first:last], kind="stable")
            text = b"".join(data[begin[i] : begin[i + 1]].tobytes() for i in order)
            payload = pack(ids[order], np.cumsum(size[order]), text)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq], pa.int64()), pa.array([last - first], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([payload], pa.binary())], ["shard_id", "n_docs", "n_bytes", "payload"])
            first, seq = last, seq + 1


def staged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The shards of all rows of ``docs``, and how many bytes of text they hold."""
    attach(docs.sparkSession)
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = checkpointed(flat.mapInArrow(lambda it: _split(it, shard_bytes), SCHEMA))
    return shards, int(shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
