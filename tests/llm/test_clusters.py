"""Operators 11 and 12 against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest

from veritab.llm import _exact, centroid_clustering, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string, code long, upper int, vector string, error string, key int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, l, 7, "x", 7, 7, "x", "x", 7) for i, v, l in rows], SCHEMA).repartition(parts)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def ints(v, scale):
    return [int(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in v]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(row, points):
    return min(range(len(points)), key=lambda j: (apart(row, points[j]), j))


def lloyd(rows, points, rounds):
    for _ in range(rounds):
        at = [nearest(r, points) for r in rows]
        own = [[r for r, a in zip(rows, at, strict=True) if a == j] for j in range(len(points))]
        points = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else p for o, p in zip(own, points, strict=True)]
    return points


def long(x):
    return x if abs(x) < 1 << 63 else None


def some(dims, seed=3, n=150):
    rng = np.random.default_rng(seed)
    rows = [(i * 7 % 1000, (rng.normal(size=dims) * 0.4).tolist(), int(i % 3)) for i in range(n)]
    rows += [(2000 + i, rows[4][1], 1) for i in range(60)]  # a third of all rows are equal
    rows += [(rows[8][0], rows[9][1], None), (None, rows[10][1], None), (None, [0.25] * dims, 2)]
    rows += [(3000 + i, (np.round(rng.normal(size=dims)) / 2).tolist(), 9) for i in range(20)]  # ties
    return rows + [(4000, None, 1), (4001, [None] + [0.5] * (dims - 1), 1), (4002, [float("nan")] * dims, 1), (4003, [float("-inf")] * dims, 1)]


def wanted_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, v) for i, v, _ in rows if usable(v) and len(v) == dims]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    whole = [ints(v, scale) for _, v in kept]
    points = lloyd(whole, [ints(v, scale) for _, v in sorted(kept, key=key)[:k]], rounds)
    at = [nearest(r, points) for r in whole]
    far = [apart(r, points[a]) for r, a in zip(whole, at, strict=True)]
    inertia = [sum(d for d, a in zip(far, at, strict=True) if a == j) for j in range(len(points))]
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((repr(i), a, long(d), long(inertia[a]), long(sum(inertia)), sha[a]) for (i, _), a, d in zip(kept, at, far, strict=True)) if kept else []


def got_clusters(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_brute_force(spark, parts):
    rows = some(8) + [(5000, [0.1] * 7, 1), (5001, [], 1)]
    assert got_clusters(centroid_clustering.clustered(frame(spark, rows, parts), dims=8)) == wanted_clusters(rows, 16, 3, 8)


def test_clusters_of_huge_components(spark):
    """Beyond 2**53 integers take over; distances beyond 64 bits are null."""
    rows = some(4, n=40) + [(6000 + i, [10.0 ** (e + 3 * i), -1.0, 0.5, 0.0], 1) for i, e in enumerate((5, 5, 6, 9, 200))]
    got = centroid_clustering.clustered(frame(spark, rows), k=6, dims=4)
    assert got_clusters(got) == sorted(wanted_clusters(rows, 6, 3, 4), key=lambda r: r[:2])


def test_clusters_of_few_and_no_rows(spark):
    few = [(3, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (5, [0.0, -3.0], None)]
    assert got_clusters(centroid_clustering.clustered(frame(spark, few), dims=2)) == wanted_clusters(few, 16, 3, 2)
    none = centroid_clustering.clustered(frame(spark, []), dims=2)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroid_clustering.clustered(frame(spark, [(1, None, 1), (2, [1.0], 1)]), dims=2).collect() == []


def test_distances_are_exact_at_the_bound():
    rng = np.random.default_rng(1)
    for most in (2**20, 2**22 + 2**21, 2**24, 2**30, 2**40, 2**61):
        rows, points = (rng.integers(-most, most, size=(n, 64)) for n in (40, 9))
        rows[0], points[0] = most, -most
        rows[1] = points[1] = 3
        want = [[apart(r, p) for p in points.tolist()] for r in rows.tolist()]
        assert _exact.distances(rows, points).tolist() == want
        assert _exact.to_points(rows[:9], points).tolist() == [want[i][i] for i in range(9)]


def wanted_codes(rows, entries, rounds, parts=4, scale=1024):
    out = []
    for n in sorted({len(v) for _, v, _ in rows if usable(v)}):
        kept = [(i, v, l) for i, v, l in rows if usable(v) and len(v) == n]
        size = -(-n // parts)
        cut = lambda v: [(ints(v, scale) + [0] * (size * parts - n))[p * size : (p + 1) * size] for p in range(parts)]
        first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
        books = [lloyd([cut(v)[p] for _, v, _ in kept], [cut(v)[p] for _, v, _ in first], rounds) for p in range(parts)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, l in kept:
            code = [nearest(c, b) for c, b in zip(cut(v), books, strict=True)]
            out.append((i, l, "".join(f"{c:02x}" for c in code), sum(apart(c, b[j]) for c, b, j in zip(cut(v), books, code, strict=True)), sha))
    total = {l: sum(r[3] for r in out if r[1] == l) for l in {r[1] for r in out}}
    return sorted((repr(i), c, long(e), long(total[l]) if all(long(r[3]) is not None for r in out if r[1] == l) else None, s) for i, l, c, e, s in out)


def got_codes(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_codes_equal_brute_force(spark, parts):
    rows = some(8) + [(5000, [0.1] * 7, 1), (5002, [0.3, 0.1, 0.1, 0.4, 0.2, 0.9, 1.5], 1), (5001, [], 4)]
    assert got_codes(vector_codes.codes(frame(spark, rows, parts), entries=20)) == wanted_codes(rows, 20, 4)


def test_codes_of_huge_components_few_and_no_rows(spark):
    rows = some(4, n=40) + [(6000 + i, [10.0 ** (e + 3 * i), -1.0, 0.5, 0.0], 1) for i, e in enumerate((5, 5, 6, 200))]
    assert got_codes(vector_codes.codes(frame(spark, rows), entries=6)) == sorted(wanted_codes(rows, 6, 4), key=lambda r: r[:2])
    few = [(3, [1.0, 2.0, 0.0, 0.0], 1), (4, [1.0, 2.0, 1.0, 0.0], 1), (4, [1.0, 2.0, 1.0, 0.0], None)]
    assert got_codes(vector_codes.codes(frame(spark, few))) == wanted_codes(few, 256, 4)
    assert vector_codes.codes(frame(spark, [])).collect() == []


def test_codes_of_repeated_entries(spark):
    """Entries that are equal from the start: the lower index keeps all rows in every round."""
    rows = [(i, [1.0, 1.0, 1.0, 1.0] if i < 12 else [float(i % 5), 2.0, 0.5, float(i % 3)], i % 2) for i in range(80)]
    assert got_codes(vector_codes.codes(frame(spark, rows), entries=16)) == wanted_codes(rows, 16, 4)


def test_label_sums_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    rows = some(4, n=40)
    assert got_codes(vector_codes.codes(frame(spark, rows), entries=5)) == wanted_codes(rows, 5, 4)


def test_bounds_spare_scans(spark):
    """On vectors in groups most parts keep their entry without a scan."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.02).tolist(), 1) for i in range(2000)]
    state, books, before = vector_codes.trained(frame(spark, rows), entries=40)
    scans = [r.scans for r in state.select("scans").collect()]
    before.unpersist()
    assert len(scans) == 2000 and min(scans) == 4 and sum(scans) < 0.5 * 2000 * 4 * 5


def test_bounds_hold():
    """After each move the bounds enclose the true distances, and skipped rows are where a scan would put them."""
    rng = np.random.default_rng(7)
    rows, book = rng.integers(-400, 400, size=(500, 4)), vector_codes.Book(rng.integers(-400, 400, size=(30, 4)))
    code = upper = lower = None
    skipped = 0
    for _ in range(8):
        code, upper, lower, scan = vector_codes.reassigned(rows, book, code, upper, lower)
        far = _exact.distances(rows, book.entries)
        assert (code == far.argmin(axis=1)).all()
        own = far[np.arange(500), code]
        far[np.arange(500), code] = far.max() + 1
        assert (np.sqrt(own) <= upper).all() and (lower <= np.sqrt(far.min(axis=1))).all()
        skipped += (~scan).sum()
        book = book.moved(_exact.means(book.entries, *_exact.sums(rows, code, 30)))
    assert skipped > 1000
