import numpy as np
from fixtures import components

from pyspark.sql import functions as F

from veritab.llm import multi_index, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, cell long, vector string, rep long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 3, 1, "x", 2) for i, v, l in rows], SCHEMA).repartition(3)


def some(n=160, dims=12):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]
    for i in range(0, 60, 3):  # near copies, of which some lie near the threshold
        rows.append((1000 + i, (np.array(rows[i][1]) + rng.normal(size=dims) * (0.02 if i % 2 else 0.19)).astype(np.float32).tolist(), rows[i][2]))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(3000, rows[5][1], 0), (3001, rows[5][1], None)]
    odd = [None, [], [0.0] * dims, [None] * dims, [float("nan")] * dims, [float("inf")] * dims, [1.0, 2.0]]
    return rows + [(4000 + i, v, 1) for i, v in enumerate(odd)]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    rows = some()
    known = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, _ in rows if usable(v)}
    want = set()
    for q in known:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(known[q], v, strict=False)), i) for i, v in known.items() if i != q)
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    for per_block in (8192, 32):
        got = threshold_topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, rows_per_block=per_block)
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want


def test_top_k_of_few_rows(spark):
    got = threshold_topk.top_k(vectors(spark, [(50, [1.0, -1.0], 1), (51, [1.0, 1.0], 1), (50, [1.0, -1.0], 1)]), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(50, 1, 51, 0)]
    assert threshold_topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def brute_top(ids, rows, query_id, query, k=5):
    score = rows @ query
    own = [(-int(x), int(i)) for i, x in zip(ids, score, strict=True) if i != query_id]
    return [(i, -x) for x, i in sorted(own)[:k]]


def test_reading_stops_early():
    """Vectors without any structure, the hardest: reading ends after 65 % of the entries, and after half with a bound carried from five times as many rows."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(24_000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(rows))
    lists, carried = (threshold_topk.SortedLists(ids[:4800], rows[:4800]) for _ in range(2))
    for q in range(0, 24_000, 800):
        assert lists.top(q, rows[q], 5) == brute_top(ids[:4800], rows[:4800], q, rows[q])
        every = brute_top(ids, rows, q, rows[q])
        assert carried.top(q, rows[q], 5, every[-1][1]) == [x for x in every if x[0] < 4800]
    assert lists.read < 0.65 * lists.held and carried.read < 0.5 * carried.held


def test_reading_stops_very_early_where_few_components_matter():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(size=(4000, 64)) * 0.7 ** np.arange(64)).astype(np.int64)
    lists = threshold_topk.SortedLists(np.arange(4000), rows)
    for q in range(0, 4000, 100):
        assert lists.top(q, rows[q], 5) == brute_top(np.arange(4000), rows, q, rows[q])
    assert lists.read < 0.2 * lists.held


def test_top_k_of_ties_zeros_and_large_components():
    ids = np.arange(600)
    for rows in (np.ones((600, 4), np.int64), np.zeros((600, 4), np.int64), np.arange(2400).reshape(600, 4) * 10**6 - 10**9):
        lists = threshold_topk.SortedLists(ids, rows)
        for q in (0, 7, 599):
            assert lists.top(q, rows[q], 5) == brute_top(ids, rows.astype(object), q, rows[q].astype(object))


def test_near_duplicates_equal_brute_force(spark):
    rows = some()
    good = {i: (np.array(v, np.float64), l) for i, v, l in rows if usable(v) and len(v) and any(v) and l is not None}
    cos = lambda a, b: len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98
    links = [(i, j) for i in good for j in good if i < j and good[i][1] == good[j][1] and cos(good[i][0], good[j][0])]
    want, many = components([i for i, _, _ in rows], links), {i: 0 for i, _, _ in rows}
    for i, j in links:
        many[i] += 1
        many[j] += 1
    for tile in (1024, 3):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(vectors(spark, rows), tile=tile).collect()}
        assert got == {i: (many[i], want[i], want[i] == i) for i in many}
    assert multi_index.near_duplicates(vectors(spark, [])).count() == 0


def test_odd_sizes_and_ids(spark):
    """Tiny and huge components, null and repeated ids, ids that doubles can't hold."""
    rows = [(1, [1e-200, 0.0, 0.0, 0.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [1e200, 2e200, 3e200, 4e200], 1), (4, [2e-200, 0.0, 0.0, 0.0], 1), (6, [-0.0, 0.0, 1.0, 0.0], 2), (8, [0.0, 0.0, 2.0, 0.0], 2)]
    rows += [(None, [1.0, 1.0, 1.0, 0.0], 3), (5, [1.0, 1.0, 1.0, 0.0], 3), (7, [1.0, 1.0, 1.0, 0.001], 3), (2**53 + 1, [1.0, 1.0, 1.0, 0.002], 3), (2**53 + 3, [1.0, 1.0, 1.0, 0.0], 3)]
    rows += [(9, [1.0, 0.0, 0.0, 0.0], 4), (9, [0.0, 1.0, 0.0, 0.0], 4), (10, [0.0, 1.0, 0.01, 0.0], 4), (11, [1.0, 0.01, 0.0, 0.0], 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(frame).collect() if r.vec_id != 9}
    last = {i: (3, 5, i == 5) for i in (5, 7, 2**53 + 1, 2**53 + 3)}
    assert got == {1: (1, 1, True), 4: (1, 1, False), 2: (1, 2, True), 3: (1, 2, False), 6: (1, 6, True), 8: (1, 6, False), None: (0, None, True), 10: (1, 9, False), 11: (1, 9, False)} | last


def test_groups_and_tiles_lose_nothing(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 8))
    rows = [(i, (base[i % 300] + rng.normal(size=8) * 0.08).tolist(), 1 if i % 3 else 2) for i in range(1500)]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = components(range(1500), list(zip(*np.nonzero(near), strict=True)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for tile, group in ((2048, 4096), (40, 90)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(frame, tile=tile, rows_per_group=group).collect()}
        assert got == {i: (int(near[i].sum()), want[i]) for i in range(1500)}


def test_recall_of_the_index():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2000, 16))
    rows = np.concatenate([base, base[:1000] + rng.normal(size=(1000, 16)) * 0.04])
    index = multi_index.MultiIndex(rows, 20_000, 0.98)
    cell, row, to = index.cells(rows)
    visits = set(zip(row.tolist(), to.tolist(), strict=True))
    a = multi_index.normalised(rows)
    i, j = np.nonzero(np.triu(a @ a.T >= 0.98, 1))
    assert len(i) > 500 and all((x, cell[y]) in visits and (y, cell[x]) in visits for x, y in zip(i, j, strict=True))
    loose = multi_index.MultiIndex(rows, 20_000, 0.98, target_recall=0.9)
    cell, row, to = loose.cells(rows)
    less = set(zip(row.tolist(), to.tolist(), strict=True))
    assert np.mean([(x, cell[y]) in less for x, y in zip(i, j, strict=True)]) >= 0.9
    assert len(less) < len(visits) < len(rows) * index.n_cells


def test_fronts_are_what_the_traversal_visits():
    rng = np.random.default_rng(9)
    a, b = rng.random((40, 9)), rng.random((40, 7))
    row, cell = multi_index.fronts(a, b, 0.8)
    assert list(zip(row.tolist(), cell.tolist(), strict=True)) == [(r, c) for r in range(40) for c in sorted(i * 7 + j for i, j in multi_index.traverse(a[r], b[r], 0.8))]


def test_components_of_hubs_and_chains(spark):
    import random

    from veritab.llm._components import components as classes

    rng, links = random.Random(6), [(0, i) for i in range(1, 9000)] + [(i, i + 1) for i in range(20_000, 20_300)] + [(8999, 30_000)]
    links += [(rng.randrange(40_000, 41_000), rng.randrange(40_000, 41_000)) for _ in range(900)]
    nodes = {x for e in links for x in e if e[0] != e[1]}
    got = {r.node: r.component for r in classes(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == components(nodes, [e for e in links if e[0] != e[1]])


def test_traversal_is_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    got = multi_index.traverse(a, b, 1.0)
    assert got == sorted(got, key=lambda c: a[c[0]] + b[c[1]]) and len(got) == sum(x + y <= 1.0 for x in a for y in b)
