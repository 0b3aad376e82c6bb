"""Nearest classes against exact sums in Python, and the match metrics on worked rows."""

import math

import numpy as np
import pytest

from veritab.operators import matching


def summed(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


@pytest.mark.parametrize("block", [None, 7])
def test_nearest_classes_equal_all_pairs(spark, block):
    """Ties, repeated rows, repeated class vectors, zero vectors, other lengths and vectors that take no part."""
    rng = np.random.default_rng(3)
    classes = [(f"c{i:02d}", [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(40)]
    classes += [("twin", classes[0][1]), ("long", [1.0] * 6), ("nan", [math.nan] * 5), ("null", [None] * 5), ("gone", None), (None, [9.0] * 5), ("empty", [])]
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)], i) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=5)], i) for i in range(60, 120)]
    rows += [(1, rows[1][1], 7), (200, [0.0] * 5, 0), (201, None, 0), (202, [1.0, None, 1.0, 1.0, 1.0], 0), (203, [math.inf] * 5, 0), (204, [1.0] * 6, 0), (205, [1.0, 2.0], 0), (206, [], 0), (None, [1e150] * 5, 0)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    table = spark.createDataFrame(classes, "label string, vector array<double>")
    got = {(r.id, r.label): r.top for r in matching.nearest_classes(df, table, "v", 4, block=block).collect()}
    good = [c for c in classes if c[0] and c[1] and all(x is not None and math.isfinite(x) for x in c[1])]
    assert len(got) == len(rows)
    for i, v, n in rows:
        top = got[i, n]
        if not v or any(x is None or not math.isfinite(x) for x in v):
            assert top is None
        else:
            want = sorted((-summed(v, w), c) for c, w in good if len(w) == len(v))[:4]
            assert [(t.far, t.label) for t in top or []] == want, i


@pytest.mark.parametrize("block", [None, 7])
def test_no_rows_and_no_classes(spark, block):
    none = spark.createDataFrame([], "label string, vector array<double>")
    df = spark.createDataFrame([(1, [1.0])], "id int, v array<double>")
    assert not matching.nearest_classes(df, none, "v", 2, block=block).first().top
    assert matching.nearest_classes(df.limit(0), none, "v", 2, block=block).count() == 0


def test_words_in_and_outside_the_vocabulary(spark):
    classes = spark.createDataFrame([("Cat", [1.0, 0.0]), ("Dog", [0.0, 1.0]), ("Sofa", [0.6, 0.6])], "label string, vector array<double>")
    rows = [
        ("first", ["Cat"], "Sofa", [1.0, 0.1], None),  # a hit; the word is second
        ("outside", ["Dog"], "Fox", [0.9, 0.1], [0.7, 0.1]),  # Dog is third; Fox is nearer than the second, Sofa
        ("nearest", ["Cat", "Dog"], "Lynx", [1.0, 0.0], [1.0, 0.0]),  # as near as the first counts
        ("novector", ["Cat"], "Yeti", [1.0, 0.0], None),
        ("noword", ["Tree"], None, [0.0, 1.0], None),
        ("nothing", ["Cat"], "Cat", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, truth array<string>, word string, vector array<double>, word_vector array<double>")
    records = matching.match_records(matching.nearest_classes(df, classes, "vector", 2), classes, 2)
    got = {r.id: (r.hit_at_1, r.hit_at_k, r.attack_at_1, r.attack_at_k) for r in records.collect()}
    assert got == {
        "first": (True, True, False, True), "outside": (False, False, False, True), "nearest": (True, True, True, True),
        "novector": (True, True, False, False), "noword": (False, False, None, None), "nothing": (False, False, False, False),
    }
    m = matching.match_metrics(records).first()
    assert (m.acc_at_1, m.asr_at_1, m.asr_at_k, m.n, m.n_attacked) == (0.5, 0.2, 0.6, 6, 5)
    empty = matching.match_metrics(records.limit(0)).first()
    assert (empty.acc_at_1, empty.asr_at_1, empty.n) == (0.0, None, 0)
