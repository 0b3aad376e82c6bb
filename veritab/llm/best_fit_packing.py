"""Best-fit decreasing packing with a segment tree over remaining capacities (operator 10).

Documents become token ids and pieces of at most ``capacity``. Best-fit decreasing only looks at lengths, so the plan is
made from how many pieces have each length: a segment tree over remaining capacities finds the tightest open sequence in
logarithmic time, and all sequences that are filled alike are one entry. The plan's size depends on the capacity alone. Pieces are
numbered within their length and look up their place in the plan.

Defined results: a null text is empty and has the end id alone, as has an empty one. Repeated rows are separate documents
(equal pieces may change places). The special token's string in a text is that token, as the tokenizer has it. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._session import attach, checkpointed, places

CAPACITY, END_ID = 1024, 2
MOST_CACHED = 200_000
SPECIAL = "<|endoftext|>"
#: Fixed value: the public pattern by which the byte-level BPE vocabulary cuts texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Irregular(Exception):
    """White space that can't be cut into words one by one."""


class _Pieces(dict):
    """Ids of words as little-endian bytes, by word. ``lead``: what stands before the word in its text."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if not word and not self.lead:
            return b""
        if not word or word != word.strip():
            raise _Irregular
        if len(self) >= MOST_CACHED:
            self.clear()
        out = np.asarray(self.encode(self.lead + word), "<u4").tobytes()
        self[word] = out
        return out


class Encoder:
    """Token ids of texts, equal to those of the tokenizer's file.

    The pattern never joins what stands before a space or newline between two other characters to what follows it. So
    texts are cut there, and words encoded once and kept; texts with other runs of white space, or with the special
    token's string, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ranks = {_to_bytes(k): v for k, v in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items() if k != SPECIAL}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Pieces(self.fast.encode_ordinary, ""), _Pieces(self.fast.encode_ordinary, " ")
        self.newline = np.asarray(self.fast.encode_ordinary("\n"), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "\n\n\n" not in text and "\n\n " not in text and not text.endswith("\n\n"):
            try:
                first, rest, lines = self.first, self.rest, []
                for line in text.split("\n"):
                    head, *tail = line.split(" ")
                    lines.append(first[head] + b"".join(map(rest.__getitem__, tail)))
                return self.newline.join(lines)
            except _Irregular:
                pass
        return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE vocabularies write each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + k)] = b
    return letters


_LETTERS = _byte_letters()
_ENCODERS: dict[str, Encoder] = {}


def _to_bytes(token: str) -> bytes:
    return bytes(_LETTERS[c] for c in token)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``length`` ids: all are full but the first."""
    head = length - capacity * ((length - 1) // capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def _pieces(batches, path: str, capacity: int, end_id: int):
    encode, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
            ids = encode(text or "") + end
            rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


class SegmentTree:
    """Which remaining capacities any open sequence has: a leaf for each capacity, a node for whether any leaf below is set."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.node = [False] * (2 * self.size)

    def put(self, i: int, value: bool) -> None:
        i += self.size
        self.node[i] = value
        while i > 1:
            i //= 2
            self.node[i] = self.node[2 * i] or self.node[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest set leaf from ``least`` on."""
        i = least + self.size
        if self.node[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.node[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, entries (first ordinal, first sequence, offset) in the order of ordinals: pieces with ordinals from there up to the next entry go one each to following sequences.

    Works like best-fit decreasing piece by piece. Where the tightest open sequence has room r, the next pieces of the same
    length L keep going into it until under L is left, so every such sequence takes r // L of them.
    """
    tree, open_, sequences = SegmentTree(capacity + 1), {}, 0
    plan: dict[int, list[tuple[int, int, int]]] = {}

    def give(room: int, first: int, many: int) -> None:
        if many and room:
            open_.setdefault(room, []).append((first, many))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left, ordinal, entries = counts[length], 0, []
        while left:
            room = tree.tightest(length) if length <= capacity else None
            if room is None:
                room = capacity
                each = room // length
                first, many = sequences, max(1, left // each)
                sequences += many
            else:
                first, many = open_[room].pop()
                if not open_[room]:
                    tree.put(room, False)
                each = room // length
            each = min(each, left)
            full = min(many, left // each)
            give(room, first + full, many - full)
            for j in range(each):
                entries.append((ordinal, first, capacity - room + j * length))
                ordinal += full
            left -= each * full
            give(room - each * length, first, full)
        plan[length] = entries
    return plan


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, seed: int = 41, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 100_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ``tokenizer``: path of its file, on every machine."""
    attach(docs.sparkSession)
    flat = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = checkpointed(flat.mapInPandas(lambda it: _pieces(it, tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length up to the capacity
    plan = {k: tuple(np.array(v, np.int64).T) for k, v in best_fit_plan(counts, capacity).items()}
    ranked = places(pieces.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32")), ["length"], [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("start")], "_rank", rows_per_block)

    def place(batches):
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for length, own in pdf.groupby("length").indices.items():
                ordinals, first, at = plan[length]
                rank = pdf["_rank"].to_numpy()[own]
                i = np.searchsorted(ordinals, rank, "right") - 1
                sequence[own], offset[own] = first[i] + rank - ordinals[i], at[i]
            yield pdf.drop(columns=["_rank", "_h"]).assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_h", "_rank").mapInPandas(place, schema)
