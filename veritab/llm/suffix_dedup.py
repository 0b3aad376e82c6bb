"""Suffix-array deduplication of byte strings that repeat across documents (operator 1).

Candidate runs of windows (see ``_windows``) are joined to shards of bounded size. Each shard gets a suffix array by
Larsson-Sadakane refinement and common prefixes by Kasai's rule, both in numpy; neighbours that share ``length`` bytes
are one class. Shards of a bucket are merged by binary search of each one's distinct strings among those before.

Defined results: a null text is an empty one. Rows with equal doc_id never count as earlier for each other; a null doc_id
is earlier than all. Documents shorter than ``length`` keep all bytes. An empty table gives no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veritab.llm._shards import NULL_ID, staged
from veritab.llm._windows import Windows, ranges, repeated

LENGTH = 50
ARRAY_BYTES = (2 << 20) - 4096


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; zeros follow the end."""
    key = np.zeros(len(text) + 8, np.uint64)
    key[: len(text)] = text
    for step in (1, 2, 4):
        key[:-step] = key[:-step] << np.uint64(8 * step) | key[step:]
    return key[: len(text)]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, as far as ``depth`` bytes: Larsson-Sadakane refinement.

    Groups of equal prefixes carry the number of their last member. A round sorts only within groups that have several
    members, by the group number that stands as far on as the prefix is long, and so doubles it. Sort keys are packed
    with the place into 64 bits, which numpy sorts several times faster than it finds an order.
    """
    n = len(text)
    bits = np.uint64((n + 1).bit_length())
    if 3 * int(bits) > 64:
        raise ValueError(f"a shard holds fewer than 2**21 bytes, not {n}")
    low = (np.uint64(1) << bits) - np.uint64(1)
    h = (64 - int(bits)) // 8
    both = words_at(text) >> np.uint64(64 - 8 * h) << bits | np.arange(n, dtype=np.uint64)
    both.sort()
    sa, both = (both & low).astype(np.int64), both >> bits
    ends = np.flatnonzero(np.concatenate([both[1:] != both[:-1], [True]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=-1)
    number = np.zeros(n + 1, np.uint64)  # what follows the end has number 0, all else 1 and more
    number[sa] = np.repeat(ends + 1, sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while h < depth and len(open_):
        own = sa[open_]
        both = number[own] << (bits + bits) | number[np.minimum(own + h, n)] << bits | own.astype(np.uint64)
        both.sort()
        own, both = (both & low).astype(np.int64), both >> bits
        sa[open_] = own
        ends = np.flatnonzero(np.concatenate([both[1:] != both[:-1], [True]]))
        sizes = np.diff(ends, prepend=-1)
        number[own] = np.repeat(open_[ends] + 1, sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, longest: int = 256) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, ``depth`` at most: Kasai's rule.

    ``order``: places of some or all suffixes, sorted as far as ``depth`` bytes at least. From place to place a common
    prefix shrinks by one at most, so comparing goes on where it stood, eight bytes at a time; this holds where the place after the
    one compared with is in ``order`` too, and where less than ``depth`` was shared, else comparing starts anew. Chains of
    neighbouring places advance together.
    """
    n, key = len(text), words_at(text)
    before, mine = np.full(n, -1), np.zeros(n + 1, bool)
    before[order[1:]] = order[:-1]
    mine[order] = True
    place = np.flatnonzero(mine)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1])) if len(place) else place
    step = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place))))
    heads = np.flatnonzero(step % longest == 0)
    sizes = np.diff(np.append(heads, len(place)))
    by = np.argsort(-sizes, kind="stable")
    heads, sizes = place[heads[by]], sizes[by]
    out, h, held = np.zeros(n, np.int64), np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, "left"))
        i = heads[:m] + t
        p = before[i]
        h = np.where(held[:m] & (h[:m] < depth), np.maximum(h[:m] - 1, 0), 0)
        go = np.flatnonzero(p >= 0)
        while len(go):
            x, y = i[go] + h[go], p[go] + h[go]
            inside = (x < n) & (y < n)
            if not inside.all():
                go, x, y = go[inside], x[inside], y[inside]
            diff = key[x] ^ key[y]
            same = diff == 0
            rest = diff[~same]
            h[go[~same]] += sum((rest < np.uint64(1 << s)).astype(np.int64) for s in range(8, 64, 8))
            go = go[same]
            h[go] += 8
            go = go[h[go] < depth]
        out[i] = np.minimum(h, depth)
        held = (p >= 0) & mine[p + 1]
    return out[order]


def classes(text: np.ndarray, starts: np.ndarray, owned: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of each run, the same for equal windows. Runs lie end to end in ``text``."""
    spans = owned + length - 1
    out = np.zeros(int(owned.sum()), np.int64)
    before = np.cumsum(owned) - owned
    known, number, made, first = np.zeros(0, f"S{length}"), np.zeros(0, np.int64), 0, 0
    while first < len(owned):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + ARRAY_BYTES)))
        last = min(last, len(owned))
        begin, end = starts[first], starts[last - 1] + spans[last - 1]
        part = text[begin:end]
        place = ranges(starts[first:last] - begin, owned[first:last])
        mine = np.zeros(len(part), bool)
        mine[place] = True
        order = suffix_array(part, length)
        order = order[mine[order]]
        heads = common_prefixes(part, order, length) < length
        group = np.cumsum(heads) - 1
        got = made + np.arange(int(heads.sum()))
        made += len(got)
        if first or last < len(owned):
            # The distinct windows of this shard, in order, are searched among those of the shards before.
            strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, length)[order[heads]]).view(f"S{length}").ravel()
            where = np.searchsorted(known, strings)
            old = known[np.minimum(where, len(known) - 1)] == strings if len(known) else np.zeros(len(strings), bool)
            got[old] = number[where[old]]
            if last < len(owned):
                known = np.insert(known, where[~old], strings[~old])
                number = np.insert(number, where[~old], got[~old])
        of_place = np.empty(len(part), np.int64)
        of_place[order] = got[group]
        out[before[first] : before[last - 1] + owned[last - 1]] = of_place[place]
        first = last
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _report(shard, found, gone) -> pd.DataFrame:
    rows = []
    if shard is not None:
        kept = ~gone
        for doc_id, a, b in zip(shard.ids, shard.starts, shard.ends, strict=True):
            own = gone[a:b]
            n = int(own.sum())
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0
            rows.append((None if doc_id == NULL_ID else int(doc_id), int(b - a), n, spans, hashlib.sha256(shard.text[a:b][kept[a:b]] if n else shard.text[a:b]).hexdigest()))
    return pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})


def removed_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per document: its bytes, how many are covered by a ``length``-byte string that a document with a smaller id also has, in how many spans, and the SHA-256 of the rest. ``options``: fields of ``Windows``."""
    w = Windows(length=length, gram=max(1, length // 2 - 1), words=False, within=False, **options)
    shards, total = staged(docs, id_col, text_col)
    return repeated(shards, total, w, classes, _report, SCHEMA, bucket_symbols=8 << 20)
