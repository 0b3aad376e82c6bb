"""N-gram Jaccard join with parity sketches (operator 4).

A document's set holds its distinct shingles. XOR-hashing them into a sketch of many words makes the number of words in
which two sketches differ a lower bound of the symmetric difference, which a Jaccard similarity of at least p bounds by
``D = (1 - p) / (1 + p) * (|A| + |B|)``. So two similar documents whose sketches have more than D words in use agree in one of
any D + 1 that either picks by a common order (pigeonhole), and those words are join keys. Sketch sizes go by size band; documents
near the end of a band also join in the next. The order puts words that many documents share last (``most_hot``
at most are known to it; any order is right, this one keeps groups small).

Documents that share a key form a group under the least of them, its hub; large groups are dealt to tiles. In a group,
one-bit parity sketches and sizes exclude pairs, the rest is verified on whole sets. Only links that join what is not yet
joined are kept, then connected components follow. Equal sets are one representative from the start.

Defined results: null and empty texts, and such without words, have an empty set and link with nothing. Documents with fewer words
than a shingle have one, the whole sequence. Rows that share a doc_id count as one document in components, each with its own
n_shingles. Rows with a null doc_id link with nothing (component_id null). Repeated rows stay repeated. An empty table gives no
rows. Other columns are ignored. Sets are told by 64-bit hashes of their shingles: two different shingles share one with a chance of about 2**-50.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import _words as W
from veritab.llm._components import components
from veritab.llm._session import checkpointed, shuffle_partitions
from veritab.llm._shards import NULL_ID, Shard, pack, staged, unpack

SHINGLE, PERCENT, TILE = 5, 75, 1024
IDX, LOW, HALF = np.uint64(24), np.uint64(0xFFFFFFFF), np.uint64(32)


def shingle_sets(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of documents that lie end to end."""
    first, last, own = W.word_bounds(W.LOWER[texts], starts, ends)
    codes = W.word_hashes(W.LOWER[texts], first, last)
    sums = W.prefix(codes)
    every = W.sliding(sums, shingle)
    out = []
    for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
        if b - a >= shingle:
            x = np.sort(every[a : b - shingle + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(W.mix(W.span(sums, np.array([a]), np.array([b])) ^ np.uint64(b - a)) if b > a else every[:0])
    return out


def sets_of(shard: Shard, shingle: int) -> list[np.ndarray]:
    out = []
    for i, j in shard.runs():
        begin = shard.starts[i]
        out += shingle_sets(shard.text[begin : shard.ends[j - 1]], shard.starts[i:j] - begin, shard.ends[i:j] - begin, shingle)
    return out


def most_different(n: int, percent: int) -> int:
    """The largest symmetric difference that a set of ``n`` has with a similar one."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def bands(n: int, percent: int) -> list[int]:
    """The size bands in which a set of ``n`` joins: its own, and the next if a similar set can lie there. Band i begins at 4**i."""
    own = (n.bit_length() - 1) // 2
    return [own, own + 1] if 100 * n // percent >= 1 << 2 * (own + 1) else [own]


def sketch_keys(shingles: np.ndarray, band: int) -> np.ndarray:
    """A key for each word in use of the band's sketch: its number and the XOR of the hashes in it. Sketches have 4 to 16 words a shingle, small ones so many that no two meet."""
    size = 4 << 2 * (band + 1) if band > 1 else 1 << 32
    word = (shingles >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return W.mix(np.bitwise_xor.reduceat(shingles, heads) ^ W.mix(word[heads] + np.uint64(band << 40)))


def chosen_keys(keys: np.ndarray, documents: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The D + 1 keys of a set of ``n`` that come first in the common order, by how many documents have them and then by value; without those that one has."""
    many = most_different(n, percent) + 1
    if many < len(keys):
        first = np.argpartition(documents.astype(np.uint64) << np.uint64(48) | keys >> np.uint64(16), many - 1)[:many]
        keys, documents = keys[first], documents[first]
    return keys[documents > 1]


def _describe(pdf: pd.DataFrame, shingle: int) -> pd.DataFrame:
    """A row for each document, with two sums that tell its set."""
    out = []
    for shard_id, payload in zip(pdf.shard_id, pdf.payload, strict=True):
        shard = Shard.of(shard_id, payload)
        sets = sets_of(shard, shingle)
        n = np.array([len(x) for x in sets], np.int64)
        s1 = np.array([W.mix(x).sum() if len(x) else 0 for x in sets], np.uint64)
        s2 = np.array([np.bitwise_xor.reduce(W.mix(x ^ np.uint64(0x5851F42D4C957F2D))) if len(x) else 0 for x in sets], np.uint64)
        out.append(pd.DataFrame({"shard_id": shard_id, "idx": np.arange(len(n)), "doc_id": shard.ids, "n": n, "s1": s1.view(np.int64), "s2": s2.view(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame(columns=["shard_id", "idx", "doc_id", "n", "s1", "s2"], dtype="int64")


def _all_keys(shard: Shard, idx: np.ndarray, shingle: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of some documents in all their bands; for each such pair the document's place, how many keys it has, and how many shingles."""
    sets = sets_of(shard, shingle)
    found = [(i, sketch_keys(sets[i], b)) for i in idx.tolist() for b in bands(len(sets[i]), percent)]
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return np.concatenate([k for _, k in found]), np.array([i for i, _ in found]), np.array([len(k) for _, k in found]), np.array([len(sets[i]) for i, _ in found])


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> HALF) % np.uint64(n)).astype(np.int64)


def _offer(shards: pd.DataFrame, reps: pd.DataFrame, shingle: int, percent: int, n: int) -> pd.DataFrame:
    """For each bucket the shard's keys: 32 bits of each, and how many documents have those that several have. The representatives travel in a row of their own, bucket -1 and below."""
    rows = []
    for shard_id, payload in zip(shards.shard_id, shards.payload, strict=True):
        idx = np.sort(reps.idx.to_numpy(np.int64))
        keys, many = np.unique(_all_keys(Shard.of(shard_id, payload), idx, shingle, percent)[0], return_counts=True)
        to, low = _bucket(keys, n), (keys & LOW).astype(np.uint32)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(n + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            one = many[own] == 1
            rows.append((int(b), int(shard_id), low[own[one]].tobytes(), pack(low[own[~one]], many[own[~one]].astype(np.uint32))))
        rows.append((-1 - int(shard_id) % n, int(shard_id), idx.tobytes(), b""))
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "keys", "several"])


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each shard those of its keys that several documents have, over all shards, and how many."""
    if pdf.bucket.iloc[0] < 0:
        return pdf
    one = [np.frombuffer(x, np.uint32) for x in pdf["keys"]]
    more = [unpack(x) for x in pdf.several]
    keys, many = np.unique(np.concatenate(one), return_counts=True)
    extra, at = np.unique(np.concatenate([x for x, _ in more]), return_inverse=True)
    added = np.bincount(at, np.concatenate([x for _, x in more]), len(extra)).astype(np.int64)
    every = np.concatenate([keys[many > 1], extra])
    every, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, np.concatenate([many[many > 1], added]), len(every)).astype(np.int64)
    # a key that one shard has several times and others once
    i = np.minimum(np.searchsorted(keys, every), max(0, len(keys) - 1))
    if len(keys):
        total += np.where((keys[i] == every) & (many[i] == 1), 1, 0)
    total = np.minimum(total, 0xFFFF).astype(np.uint16)
    rows = []
    for shard_id, x, (y, _) in zip(pdf.shard_id, one, more, strict=True):
        if len(every):
            own = np.unique(np.concatenate([x, y]))
            at = np.minimum(np.searchsorted(every, own), len(every) - 1)
            good = every[at] == own
            rows.append((int(pdf.bucket.iloc[0]), int(shard_id), own[good].tobytes(), pack(total[at[good]])))
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "keys", "several"])


def _keys(shards: pd.DataFrame, known: pd.DataFrame, shingle: int, percent: int, n: int, buckets: int) -> pd.DataFrame:
    """For each bucket the keys by which the shard's documents join, with the document's place in the lowest bits."""
    rows = []
    for shard_id, payload in zip(shards.shard_id, shards.payload, strict=True):
        own = known[known.bucket >= 0]
        if own.empty:
            continue
        idx = np.frombuffer(known["keys"][known.bucket < 0].iloc[0], np.int64)
        keys, doc, sizes, n_shingles = _all_keys(Shard.of(shard_id, payload), idx, shingle, percent)
        shared = np.concatenate([np.uint64(b) << HALF | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(own.bucket, own["keys"], strict=True)])
        many = np.concatenate([unpack(x)[0] for x in own.several])
        order = np.argsort(shared)
        shared, many = shared[order], many[order]
        mine = _bucket(keys, n).astype(np.uint64) << HALF | keys & LOW
        at = np.minimum(np.searchsorted(shared, mine), max(0, len(shared) - 1))
        documents = np.where(shared[at] == mine, many[at], 1) if len(shared) else np.ones(len(keys), np.int64)
        if not (documents > 1).any():
            continue
        ends = np.cumsum(sizes)
        found = [chosen_keys(keys[b - m : b], documents[b - m : b], k, percent) for b, m, k in zip(ends.tolist(), sizes.tolist(), n_shingles.tolist(), strict=True)]
        chosen, place = np.concatenate(found), np.repeat(doc.astype(np.uint64), [len(k) for k in found])
        to = ((chosen & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        packed = (chosen >> IDX << IDX | place)[order]
        rows += [(int(b), int(shard_id), np.sort(packed[cuts[b] : cuts[b + 1]]).tobytes()) for b in np.flatnonzero(np.diff(cuts))]
    return pd.DataFrame(rows, columns=["bucket", "shard_id", "keys"])


def _groups(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """For each shard, its documents that share a key with others, with the hub and tile of each group."""
    each = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
    shard_ids = pdf.shard_id.to_numpy(np.int64)
    order = np.argsort(shard_ids)
    shard_ids = shard_ids[order]
    every = np.concatenate([each[i] for i in order])
    shard = np.repeat(np.arange(len(order)), [len(each[i]) for i in order])
    ref = shard << 24 | (every & np.uint64((1 << 24) - 1)).astype(np.int64)
    by = np.argsort(every >> IDX, kind="stable")  # keys, and in each the order of references
    key, ref = (every >> IDX)[by], ref[by]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    hub = np.repeat(ref[heads], sizes)
    parts = np.repeat(1 << np.maximum(0, np.ceil(np.log2(sizes / tile)).astype(np.int64)), sizes)
    some = np.repeat(sizes > 1, sizes)
    hub, ref, parts = hub[some], ref[some], parts[some]
    got = np.unique(np.stack([ref, hub, parts], axis=1), axis=0)
    rows = []
    cuts = np.searchsorted(got[:, 0] >> 24, np.arange(len(shard_ids) + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = got[cuts[s] : cuts[s + 1]]
        rows.append((int(shard_ids[s]), pack((own[:, 0] & 0xFFFFFF).astype(np.int32), shard_ids[own[:, 1] >> 24], (own[:, 1] & 0xFFFFFF).astype(np.int32), own[:, 2].astype(np.int32))))
    return pd.DataFrame(rows, columns=["shard_id", "members"])


def _send(shards: pd.DataFrame, members: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Each document's text to the buckets of its groups, once to each."""
    rows = []
    for shard_id, payload in zip(shards.shard_id, shards.payload, strict=True):
        if members.empty:
            continue
        shard = Shard.of(shard_id, payload)
        idx, hub_shard, hub_idx, parts = (np.concatenate(x).astype(np.int64) for x in zip(*map(unpack, members.members), strict=True))
        got = np.unique(np.stack([idx, hub_shard, hub_idx, parts], axis=1), axis=0)
        # A document's part of a group of several meets each other part in a tile.
        own = (W.mix((got[:, 0] ^ shard_id * 7919).astype(np.uint64)) % got[:, 3].astype(np.uint64)).astype(np.int64)
        many = got[:, 3]
        other = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        got, own = np.repeat(got, many, axis=0), np.repeat(own, many)
        group = np.stack([got[:, 1], got[:, 2], got[:, 3], np.minimum(own, other), np.maximum(own, other)], axis=1)
        mixed = np.zeros(len(group), np.uint64)
        for c in range(5):
            mixed = W.mix(mixed ^ group[:, c].astype(np.uint64) + np.uint64(c + 1))
        to = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            pick = order[cuts[b] : cuts[b + 1]]
            docs, member = np.unique(got[pick, 0], return_inverse=True)
            text = b"".join(shard.text[shard.starts[i] : shard.ends[i]].tobytes() for i in docs)
            rows.append((int(b), pack(mixed[pick], member, shard.ids[docs], np.cumsum(shard.ends[docs] - shard.starts[docs]), text)))
    return pd.DataFrame(rows, columns=["bucket", "texts"])


def parity_sketches(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Bit sketches of 64 * ``words`` bits: each shingle flips the bit of its hash, so the Hamming distance is at most the symmetric difference."""
    out = np.zeros((len(sets), words), np.uint64)
    for i, x in enumerate(sets):
        bits = (np.bincount((x & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
        out[i] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out


def joining_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets that connect whatever all their links connect."""
    n = np.array([len(x) for x in sets], np.int64)
    label, links = np.arange(len(sets)), []
    words = min(1024, 1 << max(1, int(4 * n.max() // 64).bit_length()))
    sketch = parity_sketches(sets, words) if len(sets) > 3 else None
    for x in range(len(sets) - 1):
        y = x + 1 + np.flatnonzero((label[x + 1 :] != label[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x])))
        if sketch is not None and len(y):
            far = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            y = y[far * (100 + percent) <= (100 - percent) * (n[x] + n[y])]
        if not len(y):
            continue
        every = np.concatenate([sets[k] for k in y])
        held = sets[x][np.minimum(np.searchsorted(sets[x], every), n[x] - 1)] == every
        both = np.add.reduceat(held.astype(np.int64), np.cumsum(n[y]) - n[y])
        y = y[100 * both >= percent * (n[x] + n[y] - both)]
        if len(y):
            old, at = np.unique(label[y], return_index=True)
            links += [(x, int(k)) for k in y[at]]
            label[np.isin(label, old)] = label[x]
    return links


def _verify(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    groups, members, ids, sets = [], [], [], []
    for blob in pdf.texts:
        group, member, own, ends, text = unpack(blob)
        groups.append(group)
        members.append(member + len(ids))
        ids += own.tolist()
        sets += sets_of(Shard(0, own, np.asarray(ends, np.int64), np.frombuffer(text, np.uint8)), shingle)
    group, member = np.concatenate(groups), np.concatenate(members)
    order = np.argsort(group, kind="stable")
    out = []
    for own in np.split(member[order], np.flatnonzero(np.diff(group[order])) + 1):
        out += [(ids[own[a]], ids[own[b]]) for a, b in joining_links([sets[k] for k in own], percent)]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64").drop_duplicates()


def linked_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    spark = docs.sparkSession
    shards, total = staged(docs, id_col, text_col)
    flat = shards.select("shard_id", "payload")
    buckets = max(shuffle_partitions(spark), -(-total // (16 << 20)))

    def describe(it):
        for pdf in it:
            yield _describe(pdf, shingle)

    rows = checkpointed(flat.mapInPandas(describe, "shard_id long, idx long, doc_id long, n long, s1 long, s2 long"))
    reps = checkpointed(rows.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID)).groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "shard_id", "idx")).alias("rep")))
    schema = "bucket long, shard_id long, keys binary, several binary"
    offered = flat.groupBy("shard_id").cogroup(reps.select("rep.shard_id", "rep.idx").groupBy("shard_id")).applyInPandas(lambda key, a, b: _offer(a, b, shingle, percent, buckets), schema)
    known = offered.groupBy("bucket").applyInPandas(_frequencies, schema)
    keys = flat.groupBy("shard_id").cogroup(known.groupBy("shard_id")).applyInPandas(lambda key, a, b: _keys(a, b, shingle, percent, buckets, buckets), "bucket long, shard_id long, keys binary")
    members = keys.groupBy("bucket").applyInPandas(lambda pdf: _groups(pdf, tile), "shard_id long, members binary")
    sent = flat.groupBy("shard_id").cogroup(members.groupBy("shard_id")).applyInPandas(lambda key, a, b: _send(a, b, buckets), "bucket long, texts binary")
    links = sent.groupBy("bucket").applyInPandas(lambda pdf: _verify(pdf, shingle, percent), "u long, v long")
    same = rows.where((F.col("n") > 0) & (F.col("doc_id") != NULL_ID)).join(reps, ["n", "s1", "s2"]).where("doc_id <> rep.doc_id").select(F.col("doc_id").alias("u"), F.col("rep.doc_id").alias("v"))
    classes = components(links.unionByName(same))
    known = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    component = F.coalesce("component", "doc_id")
    return rows.join(classes, F.col("doc_id") == F.col("node"), "left").select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"))
