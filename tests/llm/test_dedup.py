import hashlib

import numpy as np
import pytest
from fixtures import components, documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import parity_join, suffix_dedup, tree_dedup
from veritab.llm._components import components as connected


def brute_bytes(rows, length):
    out, seen = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        own = set()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            own.add(w)
            if w in seen:
                gone[k : k + length] = [True] * length
        for w in own:
            seen.setdefault(w, i)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


#: All grams that recur are hot, some are, none are.
HEAT = [{"hot_runs": 0, "told_runs": 0}, {"hot_runs": 3, "told_runs": 1}, {}]


def rims(n=60):
    """Boilerplate with another context in each document, and repeats of it at other places."""
    line = "This line of boilerplate stands in every one of the documents of this table, word for word, and ends here, after twenty words."
    return [(k, f"{k * 7919} begins {line} and then {k * 104729} goes on" + (f" {line} {line}" if k % 7 == 0 else "")) for k in range(n)]


@pytest.mark.parametrize("heat", HEAT)
def test_removed_substrings_equal_brute_force(spark, heat):
    rows = list(enumerate(texts())) + [(100 + k, t) for k, t in rims()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_substrings(documents(spark, rows), **heat).collect()}
    assert got == brute_bytes(rows, 50)


def test_removed_substrings_of_all_documents(spark, tables):
    """Over the whole smallest table, and over several shards a partition."""
    rows = [(r.doc_id, r.text) for r in tables("documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_substrings(tables("documents").repartition(5)).collect()}
    assert got == brute_bytes(rows, 50)


def test_removed_substrings_of_odd_rows(spark):
    text = texts()[0]
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup.removed_substrings(documents(spark, [(None, text), (3, text), (3, text), (9, None)])).collect())
    assert got == [(False, 0), (False, len(text)), (False, len(text)), (True, 0)]
    assert suffix_dedup.removed_substrings(documents(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(c % 3 for c in b)), st.integers(2, 60))
def test_suffix_array_and_common_prefixes(text, depth):
    t = np.frombuffer(text * 2, np.uint8)
    sa = suffix_dedup.suffix_array(t, depth)
    b = t.tobytes()
    padded = b + bytes(80)
    assert [padded[i : i + depth] for i in sa] == sorted(padded[i : i + depth] for i in range(len(b)))
    lcp = suffix_dedup.common_prefixes(t, sa, depth)
    for k in range(1, len(b)):
        i, j, n = sa[k - 1], sa[k], 0
        while n < depth and max(i, j) + n < len(b) and b[i + n] == b[j + n]:
            n += 1
        assert lcp[k] == n or (max(i, j) + n == len(b) and lcp[k] >= n)


def test_shards_are_merged(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 300)
    rng = np.random.default_rng(0)
    runs = [bytes(rng.integers(97, 99, 60).tolist()) for _ in range(20)]
    runs += runs[:5]
    text = np.frombuffer(b"".join(runs), np.uint8)
    owned = np.full(len(runs), 11)
    got = suffix_dedup.classes(text, np.arange(len(runs)) * 60, owned, 50)
    windows = [r[k : k + 50] for r in runs for k in range(11)]
    assert len(set(got.tolist())) == len(set(windows)) == len(set(zip(got.tolist(), windows, strict=True)))


def brute_words(rows, length):
    out, seen = {}, set()
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("heat", HEAT)
def test_removed_passages_equal_brute_force(spark, heat):
    rows = list(enumerate(texts())) + [(100 + k, t) for k, t in rims()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in tree_dedup.removed_passages(documents(spark, rows), **heat).collect()}
    assert got == brute_words(rows, 20)
    assert tree_dedup.removed_passages(documents(spark, [])).count() == 0


def test_prefixes_split_large_groups():
    words = np.array([1, 1, 1, 1, 2, 1, 1, 3, 1, 2] * 50 + [0] * 20)
    places = np.arange(500)
    groups = tree_dedup.prefix_groups(words, places, 4, limit=60)
    assert sorted(np.concatenate(groups).tolist()) == places.tolist()
    of = {}
    for g, own in enumerate(groups):
        for p in own:
            assert of.setdefault(tuple(words[p : p + 4]), g) == g


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("tile", [1024, 2])
def test_linked_documents_equal_brute_force(spark, tile):
    rows = list(enumerate(texts()))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.linked_documents(documents(spark), tile=tile).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_linked_documents_of_odd_rows(spark):
    same, rest = "a b c d e f", "other words here now ok"
    rows = [(None, same), (5, same), (7, same), (5, rest), (9, rest), (9, rest), (None, None), (11, None), (12, "  "), (13, "two words"), (14, "TWO  words")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in parity_join.linked_documents(documents(spark, rows)).collect())
    assert got == [(False, 5, 1, 5), (False, 5, 2, 5), (False, 7, 2, 5), (False, 9, 1, 5), (False, 9, 1, 5), (False, 11, 0, 11), (False, 12, 0, 12), (False, 13, 1, 13), (False, 14, 1, 13), (True, 0, 0, None), (True, 0, 2, None)]
    assert parity_join.linked_documents(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_similar_sets_share_a_chosen_key(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    keep = max(1, int(np.ceil(0.75 * n)))
    b = np.unique(np.concatenate([a[:keep], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, (4 * keep) // 3 - n + 1))), dtype=np.uint64)]))
    a = np.unique(a)
    both = len(np.intersect1d(a, b))
    if 100 * both < 75 * (len(a) + len(b) - both):
        return
    keys = lambda x: set().union(*[parity_join.chosen_keys(k := parity_join.sketch_keys(x, i), np.full(len(k), 2), len(x), 75).tolist() for i in parity_join.bands(len(x), 75)])
    assert keys(a) & keys(b)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 300, 200, dtype=np.uint64)) for _ in range(2))
    s = parity_join.parity_sketches([a, b], 4)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {x for l in links for x in l if l[0] != l[1]}
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == components(nodes, [l for l in links if l[0] != l[1]])
