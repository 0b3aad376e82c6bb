"""Joins of rectangles by cells and of names by prefixes against plain loops."""

import random

import pytest

from veritab.operators import joins

SCHEMA = "k string, id long, rect struct<x0:double,y0:double,x1:double,y1:double>"
INF, NAN = float("inf"), float("nan")


def rects(seed):
    rng = random.Random(seed)
    out = []
    for i in range(160):
        x, y, w, h = rng.randrange(-500, 900), rng.randrange(-500, 900), rng.choice([1, 5, 60, 64, 128, 700]), rng.choice([1, 7, 64, 65, 300])
        out.append((rng.choice(["hot", "hot", "hot", "cold"]), i, (float(x), float(y), float(x + w), float(y + h))))
    out += [("hot", 200, (0.0, 0.0, 64.0, 64.0)), ("hot", 201, (64.0, 0.0, 128.0, 64.0)), ("hot", 202, (-1e6, -3.0, 1e6, 9.5)), ("hot", 203, (0.25, 0.25, 0.5, 0.5))]
    odd = [None, (None, 0.0, 5.0, 5.0), (5.0, 5.0, 5.0, 9.0), (9.0, 0.0, 2.0, 5.0), (0.0, 0.0, INF, 5.0), (0.0, NAN, 5.0, 5.0), (NAN, NAN, NAN, NAN)]
    return out + [("hot", 300 + i, r) for i, r in enumerate(odd)] + [(None, 400, (0.0, 0.0, 999.0, 999.0)), out[3], out[3]]


def good(r):
    return r is not None and all(x is not None and abs(x) < 1e15 for x in r) and r[0] < r[2] and r[1] < r[3]


def meet(a, b):
    return a[0] is not None and a[0] == b[0] and good(a[2]) and good(b[2]) and a[2][0] < b[2][2] and b[2][0] < a[2][2] and a[2][1] < b[2][3] and b[2][1] < a[2][3]


def test_pairs_equal_loops(spark):
    a, b = rects(1), rects(2)
    left, right = spark.createDataFrame(a, SCHEMA).withColumnRenamed("id", "a"), spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "b")
    got = sorted(tuple(r) for r in joins.meeting_rects(left.repartition(3), right, "k", ("a", "b")).collect())
    assert got == sorted((x[0], x[1], y[1]) for x in a for y in b if meet(x, y)) and len(got) > 300
    none = right.limit(0)
    assert joins.meeting_rects(left, none, "k", ("a", "b")).count() == 0 and joins.meeting_rects(none.withColumnRenamed("b", "a"), right, "k", ("a", "b")).count() == 0


@pytest.mark.parametrize("most", [1000, 5])
def test_free_rects_equal_loops(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_TOGETHER", most)
    a, b = rects(3) + [("cold", 500 + i, (5000.0 + i, 0.0, 5001.0 + i, 1.0)) for i in range(5)], rects(4)[:40] + [("cold", 9, None)]
    got = joins.free_rects(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "k").collect()
    assert sorted(repr(r.id) for r in got) == sorted(repr(x[1]) for x in a if not any(meet(x, y) for y in b))
    assert joins.free_rects(spark.createDataFrame(a, SCHEMA), spark.createDataFrame([], SCHEMA), "k").count() == len(a)


def test_prefixes_equal_loops(spark):
    files = [f"/d/{n}" for n in ["img1_2.png", "img1_22.png", "img10", "x-img1", "img", "é_1.jpg", "img1_2.png"]] + ["bare", "/img1/other", None]
    wishes = ["img1_2", "img1", "img", "", None, "zzz", "é", "b", "img1", "img1_22.png and more"]
    left = spark.createDataFrame(list(enumerate(wishes)), "i int, wanted string")
    got = sorted(tuple(r) for r in joins.by_prefix(left, spark.createDataFrame([(f,) for f in files], "path string"), "wanted").select("i", "path").collect())
    want = [(i, min(f for f in files if f and f.rpartition("/")[2].startswith(w))) for i, w in enumerate(wishes) if w and any(f and f.rpartition("/")[2].startswith(w) for f in files)]
    assert got == sorted(want)
    assert joins.by_prefix(left.limit(0), spark.createDataFrame([("a",)], "path string"), "wanted").count() == 0


def test_cells_are_not_broadcast(spark):
    a, b = spark.createDataFrame(rects(1), SCHEMA).withColumnRenamed("id", "a"), spark.createDataFrame(rects(2), SCHEMA).withColumnRenamed("id", "b")
    met = joins.meeting_rects(a, b, "k", ("a", "b"))
    met.collect()
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
