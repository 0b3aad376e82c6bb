"""Deduplication of repeated passages with prefix-partitioned suffix trees over words (operator 9).

Candidate runs of windows (see ``_windows``) hold the suffixes. Variable-length prefixes split a bucket's suffixes into
groups that fit in memory: a prefix that too many suffixes share is made one word longer, small neighbours are joined.
Each group's suffixes are sorted and their common prefixes taken, which is its suffix tree in linear form; an internal
node ``length`` words deep is a repeat, and its leaves are the places of one window.

Defined results: a null text has no words. Rows with equal doc_id are separate documents, in the order of their shards.
Documents with fewer than ``length`` words keep all. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veritab.llm._shards import NULL_ID, staged
from veritab.llm._windows import Windows, ranges, repeated

LENGTH = 20
GROUP_SUFFIXES = 200_000


def prefix_groups(words: np.ndarray, places: np.ndarray, length: int, limit: int = GROUP_SUFFIXES) -> list[np.ndarray]:
    """``places`` in groups of at most ``limit``, where no prefix of ``length`` words lies in two groups; a group is larger only if one whole window is."""
    todo, groups, small = [(places, 0)], [], []
    while todo:
        own, depth = todo.pop()
        if len(own) <= limit or depth == length:
            small.append(own)
            continue
        order = np.argsort(words[own + depth], kind="stable")
        own = own[order]
        cuts = np.flatnonzero(np.diff(words[own + depth])) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(own)]]))
        # Neighbouring prefixes share a group as long as they fit; those too frequent alone get longer prefixes.
        begin, held = 0, 0
        for size in sizes.tolist():
            if size > limit:
                if held:
                    small.append(own[begin : begin + held])
                todo.append((own[begin + held : begin + held + size], depth + 1))
                begin, held = begin + held + size, 0
            elif held + size > limit:
                small.append(own[begin : begin + held])
                begin, held = begin + held, size
            else:
                held += size
        if held:
            small.append(own[begin : begin + held])
    for own in small:
        groups.append(own)
    return groups


def suffix_tree(words: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of the tree over the suffixes at ``places``, cut at ``length`` words, in order; and the depth of the node that each shares with the one before."""
    rows = np.ascontiguousarray(words[places[:, None] + np.arange(length)].astype(">u4"))
    order = np.argsort(rows.view(f"V{4 * length}").ravel().view(f"S{4 * length}"), kind="stable")
    rows = rows[order]
    same = rows[1:] == rows[:-1]
    depth = np.where(same.all(axis=1), length, same.argmin(axis=1))
    return places[order], np.concatenate([[0], depth])


def classes(words: np.ndarray, starts: np.ndarray, owned: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of each run, the same for the leaves of one node ``length`` words deep."""
    places = ranges(starts, owned)
    of_place, made = np.empty(len(words), np.int64), 0
    for group in prefix_groups(words, places, length):
        leaves, depth = suffix_tree(words, group, length)
        node = np.cumsum(depth < length) - 1
        of_place[leaves] = made + node
        made += int(node[-1]) + 1
    return of_place[places]


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _report(shard, found, gone) -> pd.DataFrame:
    rows = []
    if shard is not None:
        for i, doc_id in enumerate(shard.ids):
            a, b = found.bounds[i], found.bounds[i + 1]
            kept = a + np.flatnonzero(~gone[a:b])
            text = shard.text[shard.starts[i] : shard.ends[i]].tobytes()
            parts = text.split()
            if len(kept) < b - a:
                parts = [parts[k] for k in (kept - a).tolist()]
            rows.append((None if doc_id == NULL_ID else int(doc_id), int(b - a), int(b - a - len(kept)), hashlib.sha256(b" ".join(parts)).hexdigest()))
    return pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per document: its words, how many are covered by a ``length``-word window that also starts earlier, and the SHA-256 of the rest. ``options``: fields of ``Windows``."""
    w = Windows(length=length, gram=max(1, 2 * length // 5), words=True, within=True, **options)
    shards, total = staged(docs, id_col, text_col)
    return repeated(shards, total // 4, w, classes, _report, SCHEMA, bucket_symbols=2 << 20)
