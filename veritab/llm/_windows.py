"""Which windows of a fixed number of symbols repeat an earlier window, over all documents.

Symbols are bytes or words. A corpus has one window for nearly every symbol, far too many to exchange. So each window is
filed under one gram inside it, the one with the least hash (equal windows hold equal grams, so they meet), and what
follows each other under one gram forms a *run* of windows. Four passes over the shards exchange little:

1. 32 bits of every gram's hash are counted over all shards, in buckets; grams that occur once end here.
2. Of runs under grams that recur, each shard sends every distinct one once, with its symbols.
3. In each bucket a *resolver* (suffix arrays for bytes, suffix trees for words) finds equal windows among the runs and
   the earliest place of each; a run gets back a bit for each window that has an earlier equal.
4. Each shard marks the windows of its runs and of their repeats, and reports its documents.

Buckets grow in number with the corpus, so that memory does not grow. A gram under which very many different runs lie, as at
the rim of boilerplate, would fill one bucket: its runs are cut into single windows, which go to buckets by the hash of the whole
window. Gram hashes only choose candidates: a collision of two costs work, never a result. Runs and windows that are equal as a whole are
told by 64-bit hashes of their symbols; symbols themselves are compared among different runs of a bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veritab.llm import _words as W
from veritab.llm._session import shuffle_partitions
from veritab.llm._shards import Shard, pack, unpack

LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Windows:
    """``length``: symbols of a window; ``gram``: of a gram; ``words``: symbols are words, else bytes; ``within``: repeats in one document count.

    A gram with over ``hot_runs`` different runs is hot; a shard names those with over ``told_runs`` of its own, others count as one run a shard.
    """

    length: int
    gram: int
    words: bool
    within: bool
    hot_runs: int = 20_000
    told_runs: int = 16


@dataclass
class Scan:
    """Runs of a shard, in the order of their places. ``at``: first window; ``owned``: windows; ``doc``: its document in the shard; ``key``: hash of its symbols; ``gram``: hash of its gram. ``bounds``: first symbol of every document, and the end. ``first``, ``last``: bytes of each word."""

    at: np.ndarray
    owned: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    gram: np.ndarray
    bounds: np.ndarray
    first: np.ndarray | None
    last: np.ndarray | None
    codes: np.ndarray | None


@functools.lru_cache(8)
def _counts(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64)


def _count(n: int) -> np.ndarray:
    return _counts(1 << max(16, n.bit_length()))[:n]


def _runs(codes: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    n = len(codes) - w.length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = W.prefix(codes)
    grams = W.sliding(sums, w.gram)
    least = grams & ~LOW
    least |= _count(len(grams))
    width, done = w.length - w.gram + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    place = (least & LOW).astype(np.uint32)
    # Windows that would cross the end of a document are none.
    valid = np.ones(n, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[max(a, b - w.length + 1) : b] = False
    same = (place[1:] == place[:-1]) & valid[1:] & valid[:-1]
    opens, closes = valid.copy(), valid.copy()
    opens[1:] &= ~same
    closes[:-1] &= ~same
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    p = place[a].astype(np.int64)
    return a, b - a + 1, W.mix(grams[p]), W.mix(W.span(sums, a, b + w.length) ^ W.mix((p - a).astype(np.uint64)))


def scan(shard: Shard, w: Windows, keep_codes: bool = False) -> Scan:
    parts, firsts, lasts, held, bounds, base = [], [], [], [], [np.zeros(1, np.int64)], 0
    starts, ends = shard.starts, shard.ends
    for i, j in shard.runs():
        text = shard.text[starts[i] : ends[j - 1]]
        if w.words:
            first, last, own = W.word_bounds(text, starts[i:j] - starts[i], ends[i:j] - starts[i])
            codes = W.word_hashes(text, first, last)
            firsts.append(first + starts[i])
            lasts.append(last + starts[i])
        else:
            codes, own = W.CODES[text], np.append(starts[i:j], ends[j - 1]) - starts[i]
        at, owned, gram, key = _runs(codes, own, w)
        parts.append((at + base, owned, np.searchsorted(own, at, "right") - 1 + i, key, gram))
        # Empty documents share their start with the next one; the last of them that starts there holds the symbols.
        bounds.append(own[1:] + base)
        base += len(codes)
        if keep_codes:
            held.append(codes)
    cat = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    return Scan(*cat, np.concatenate(bounds), np.concatenate(firsts) if firsts else None, np.concatenate(lasts) if lasts else None, np.concatenate(held) if held else None)


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _short(gram: np.ndarray, n: int) -> np.ndarray:
    """What is exchanged of a gram: its bucket and its lower half."""
    return _bucket(gram, n).astype(np.uint64) << np.uint64(32) | gram & LOW


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at ``starts``, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def by_windows(shard: Shard, found: Scan, hot: np.ndarray, w: Windows, n: int) -> tuple[Scan, np.ndarray]:
    """The runs with those under hot grams cut into single windows, in the order of their places; and which ones are such."""
    cut = np.isin(_short(found.gram, n), hot) if len(hot) else np.zeros(len(found.gram), bool)
    if not cut.any():
        return found, cut
    some = np.flatnonzero(cut)
    run = np.repeat(some, found.owned[some])
    at = found.at[run] + ranges(np.zeros(len(some), np.int64), found.owned[some])
    power, key = W.powers(w.length)[0][: w.length], np.empty(len(at), np.uint64)
    for a in range(0, len(at), 1 << 14):
        places = at[a : a + (1 << 14), None] + np.arange(w.length)
        codes = found.codes[places] if w.words else W.CODES[shard.text[places]]
        key[a : a + (1 << 14)] = W.mix((codes * power).sum(axis=1) ^ np.uint64(0x5851F42D4C957F2D))
    parts = zip((found.at, found.owned, found.doc, found.key, found.gram), (at, np.ones(len(at), np.int64), found.doc[run], key, found.gram[run]), strict=True)
    every = [np.concatenate([old[~cut], new]) for old, new in parts]
    single = np.concatenate([np.zeros(int((~cut).sum()), bool), np.ones(len(at), bool)])
    order = np.argsort(every[0], kind="stable")
    return Scan(*[x[order] for x in every], found.bounds, found.first, found.last, found.codes), single[order]


def _grams(pdf: pd.DataFrame, w: Windows, n: int) -> pd.DataFrame:
    rows = []
    for shard_id, payload in zip(pdf.shard_id, pdf.payload, strict=True):
        found = scan(Shard.of(shard_id, payload), w)
        values, counts = np.unique(found.gram, return_counts=True)
        # Grams with many different runs: only those with as many runs at all can be such.
        many = np.flatnonzero(np.isin(found.gram, values[counts > w.told_runs]))
        named, runs = np.unique(found.gram[many[np.unique(found.key[many], return_index=True)[1]]], return_counts=True)
        named, runs = named[runs > w.told_runs], runs[runs > w.told_runs]
        of = _bucket(named, n)
        values = np.repeat(values, np.minimum(counts, 2))
        bucket = _bucket(values, n)
        low = (values & LOW).astype(np.uint32)
        for b in range(n) if n < 64 else np.unique(bucket):
            if len(own := low[bucket == b]):
                rows.append((int(b), int(shard_id), np.sort(own).tobytes(), pack((named[of == b] & LOW).astype(np.uint32), runs[of == b]) if (of == b).any() else b""))
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "grams", "runs"])


def _recurring(pdf: pd.DataFrame, w: Windows) -> pd.DataFrame:
    """For each shard those of its grams that recur, and which of them are hot."""
    each = [np.frombuffer(x, np.uint32) for x in pdf.grams]
    every = np.sort(np.concatenate(each))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    told = [unpack(x) for x in pdf.runs if len(x)]
    named, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in told]]), return_inverse=True)
    runs = np.bincount(at, np.concatenate([np.zeros(0), *[x for _, x in told]]), len(named))
    # A gram that any shard names is hot by the runs told and the places found elsewhere.
    runs = runs + np.searchsorted(every, named, "right") - np.searchsorted(every, named)
    hot = named[runs > w.hot_runs]
    rows = []
    for shard_id, own in zip(pdf.shard_id, each, strict=True):
        own = np.unique(own)
        at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
        own = own[shared[at] == own] if len(shared) else own[:0]
        if len(own):
            rows.append((int(pdf.bucket.iloc[0]), int(shard_id), own.tobytes(), own[np.isin(own, hot)].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "grams", "runs"])


def _send(shards: pd.DataFrame, grams: pd.DataFrame, w: Windows, n: int, buckets: int) -> pd.DataFrame:
    rows = []
    for shard_id, payload in zip(shards.shard_id, shards.payload, strict=True):
        if grams.empty:
            continue
        shard = Shard.of(shard_id, payload)
        whole = lambda column: np.sort(np.concatenate([np.uint64(b) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(grams.bucket, column, strict=True)]))
        shared, hot = whole(grams.grams), whole(grams.runs)
        found, single = by_windows(shard, scan(shard, w, keep_codes=w.words), hot, w, n)
        if len(hot):
            rows.append((-1 - int(shard_id), int(shard_id), hot.tobytes()))  # for the shard's own last pass
        own = _short(found.gram, n)
        kept = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own)
        kept = np.sort(kept[np.unique(found.key[kept], return_index=True)[1]])
        to = ((np.where(single, found.key, found.gram)[kept] & LOW) % np.uint64(buckets)).astype(np.int64)
        symbols = found.codes if w.words else shard.text
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            i = kept[order[cuts[b] : cuts[b + 1]]]
            sizes = found.owned[i] + w.length - 1
            content = symbols[ranges(found.at[i], sizes)]
            content = np.unique(content, return_inverse=True) if w.words else (content.tobytes(), None)
            content = (content[0], content[1].astype(np.uint32)) if w.words else content
            rows.append((int(b), int(shard_id), pack(found.key[i], shard.ids[found.doc[i]], found.doc[i], found.at[i], found.owned[i].astype(np.int16), *content)))
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "runs"])


def _resolve(pdf: pd.DataFrame, w: Windows, classes: Callable) -> pd.DataFrame:
    """``classes`` gives equal windows of the joined symbols equal numbers: ``classes(symbols, starts, owned, length)``."""
    if pdf.bucket.iloc[0] < 0:
        return pdf[["shard_id"]].assign(masks=None, hot=pdf.runs)
    metas, symbols, owns, known = [], [], [], np.zeros(0, np.uint64)
    for blob in pdf.runs:
        keys, ids, docs, at, owned, content, codes = unpack(blob)
        metas.append((keys, ids, docs, at))
        where = np.searchsorted(known, keys)
        fresh = known[np.minimum(where, len(known) - 1)] != keys if len(known) else np.ones(len(keys), bool)
        # Of runs that are equal as a whole, one stands for all.
        fresh = np.flatnonzero(fresh)
        fresh = fresh[np.unique(keys[fresh], return_index=True)[1]]
        if len(fresh):
            sizes = owned.astype(np.int64) + w.length - 1
            content = content[codes] if w.words else np.frombuffer(content, np.uint8)
            symbols.append(content[ranges((np.cumsum(sizes) - sizes)[fresh], sizes[fresh])])
            owns.append((keys[fresh], owned[fresh].astype(np.int64)))
            known = np.insert(known, np.searchsorted(known, keys[fresh]), keys[fresh])
    sizes = [len(x[0]) for x in metas]
    keys, ids, docs, at = (np.concatenate([x[k] for x in metas]) for k in range(4))
    shard = np.repeat(pdf.shard_id.to_numpy(np.int64), sizes)
    # A run's rank by document, then place; runs of equal ids rank alike where only smaller ids count.
    order = np.lexsort((at, docs, shard, ids)) if w.within else np.argsort(ids, kind="stable")
    fresh = np.concatenate([[True], ids[order][1:] != ids[order][:-1]]) if not w.within else np.ones(len(order), bool)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    of = np.searchsorted(known, keys)
    best = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(best, of, rank)
    held, owned = (np.concatenate([x[k] for x in owns]) for k in range(2))
    symbols = np.concatenate(symbols)
    if w.words:
        symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    spans = owned + w.length - 1
    found = classes(symbols, np.cumsum(spans) - spans, owned, w.length)
    del symbols
    run = np.repeat(np.searchsorted(known, held), owned)
    offset = ranges(np.zeros(len(owned), np.int64), owned)
    place = best[run] * (1 << 16) + offset if w.within else best[run]
    first = np.full(int(found.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, found, place)
    bits = np.where(first[found] < place, np.uint64(1) << offset.astype(np.uint64), np.uint64(0))
    masks = np.zeros(len(known), np.uint64)
    masks[np.searchsorted(known, held)] = np.bitwise_or.reduceat(bits, np.cumsum(owned) - owned)
    masks = np.where(rank > best[of], ~np.uint64(0), masks[of])
    rows, begin = [], 0
    for shard_id, size in zip(pdf.shard_id, sizes, strict=True):
        some = begin + np.flatnonzero(masks[begin : begin + size])
        if len(some):
            rows.append((int(shard_id), pack(keys[some], masks[some]), None))
        begin += size
    return pd.DataFrame(rows, columns=["shard_id", "masks", "hot"])


def removed(shard: Shard, found: Scan, masks: list[bytes], w: Windows) -> np.ndarray:
    """For every symbol of the shard, whether a repeated window covers it."""
    total = int(found.bounds[-1])
    hit = np.zeros(len(found.at), np.uint64)
    if masks:
        got = [unpack(x) for x in masks]
        keys, bits = (np.concatenate([x[k] for x in got]) for k in range(2))
        order = np.argsort(keys)
        keys, bits = keys[order], bits[order]
        at = np.minimum(np.searchsorted(keys, found.key), len(keys) - 1)
        hit = np.where(keys[at] == found.key, bits[at], np.uint64(0))
    _, head, inverse = np.unique(found.key, return_index=True, return_inverse=True)
    head = head[inverse]
    later = head != np.arange(len(head)) if w.within else shard.ids[found.doc] > shard.ids[found.doc[head]]
    hit = np.where(later, ~np.uint64(0), hit)
    some = np.flatnonzero(hit)
    run = np.repeat(some, found.owned[some])
    offset = ranges(np.zeros(len(some), np.int64), found.owned[some])
    start = (found.at[run] + offset)[(hit[run] >> offset.astype(np.uint64) & np.uint64(1)).astype(bool)]
    if not len(start):
        return np.zeros(total, bool)
    flag = np.zeros(total, np.int8)
    flag[start] = 1
    so_far = np.cumsum(flag, dtype=np.int32)
    gone = so_far.copy()
    gone[w.length :] -= so_far[: -w.length]
    return gone > 0


def repeated(shards: DataFrame, n_symbols: int, w: Windows, classes: Callable, report: Callable, schema: str, bucket_symbols: int) -> DataFrame:
    """``report(shard, scan, removed)`` gives the rows of a shard's documents, as a pandas table of ``schema``."""
    grams = 2 * n_symbols // (w.length - w.gram + 2)
    n = max(shuffle_partitions(shards.sparkSession), -(-grams // 2_000_000))
    buckets = max(shuffle_partitions(shards.sparkSession), -(-n_symbols // bucket_symbols))

    def note(it):
        for pdf in it:
            yield _grams(pdf, w, n)

    def mark(key, own, masks):
        out = []
        for shard_id, payload in zip(own.shard_id, own.payload, strict=True):
            shard = Shard.of(shard_id, payload)
            hot = np.frombuffer(b"".join(masks.hot.dropna()), np.uint64)
            found = scan(shard, w, keep_codes=w.words and len(hot) > 0)
            split = by_windows(shard, found, hot, w, n)[0]
            out.append(report(shard, found, removed(shard, split, list(masks.masks.dropna()), w)))
        return pd.concat(out) if out else report(None, None, None)

    flat = shards.select("shard_id", "payload")
    schema_of_grams = "bucket long, shard_id long, grams binary, runs binary"
    known = flat.mapInPandas(note, schema_of_grams).groupBy("bucket").applyInPandas(lambda pdf: _recurring(pdf, w), schema_of_grams)
    runs = flat.groupBy("shard_id").cogroup(known.groupBy("shard_id")).applyInPandas(lambda key, a, b: _send(a, b, w, n, buckets), "bucket long, shard_id long, runs binary")
    masks = runs.groupBy("bucket").applyInPandas(lambda pdf: _resolve(pdf, w, classes), "shard_id long, masks binary, hot binary")
    return flat.groupBy("shard_id").cogroup(masks.groupBy("shard_id")).applyInPandas(mark, schema)
