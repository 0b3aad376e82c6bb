"""Closures by doubling and pruning by bitmaps against plain sets."""

import json
import random

import pytest

from veritab.operators import hierarchy as H
from veritab.operators import labels as L


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def plain(pairs):
    """(descendants, depths, cycle members) by walking; depths only for what no cycle holds."""
    down = {}
    for a, b in pairs:
        down.setdefault(a, set()).add(b)
    names = {x for p in pairs for x in p}

    def below(x):
        seen, todo = set(), list(down.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += down.get(y, ())
        return seen

    return {x: below(x) for x in names}


def depths(pairs):
    reach = plain(pairs)
    place = {x: min([x] + [y for y in reach[x] if x in reach[y]]) for x in reach}
    merged = {(place[a], place[b]) for a, b in pairs if place[a] != place[b]}
    tops = {a for a, _ in pairs} - {b for _, b in pairs}
    found, todo = {(t, 1) for t in tops}, [(t, 1) for t in tops]
    while todo:
        x, d = todo.pop()
        for a, b in merged:
            if a == x and (b, d + 1) not in found:
                found.add((b, d + 1))
                todo.append((b, d + 1))
    return {(x, d) for x in reach for y, d in found if place[x] == y}


def closed(pairs):
    reach, at = plain(pairs), depths(pairs)
    return {(y, d, x) for x, d in at for y in reach[x] if x != y}


GRAPHS = {
    "chain": [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(37)],
    "dag": [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("r", "d"), ("q", "b"), ("a", "b"), ("d", "e")],
    "cycle below a root": [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("r", "y")],
    "two cycles": [("r", "a"), ("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "m"), ("n", "z"), ("r", "m")],
    "no root": [("a", "b"), ("b", "a"), ("b", "c")],
    "own parent": [("r", "a"), ("a", "a"), ("a", "b")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_closures_equal_walks(spark, name):
    e = edges(spark, GRAPHS[name] * 2)
    assert {(r.label, r.depth, r.ancestor) for r in H.closure_of_edges(e).collect()} == closed(GRAPHS[name])
    assert {(r.label, r.descendant) for r in H.descendants(e).collect()} == {(x, y) for x, ys in plain(GRAPHS[name]).items() for y in ys}


def test_closures_of_nulls_and_nothing(spark):
    assert H.closure_of_edges(edges(spark, [])).count() == 0 and H.descendants(edges(spark, [])).count() == 0
    odd = edges(spark, [(None, "a"), ("a", None), ("a", "b")])
    assert [tuple(r) for r in H.closure_of_edges(odd).collect()] == [("b", 1, "a")]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    real = H.cut
    monkeypatch.setattr(H, "cut", lambda df: rounds.append(1) or real(df))
    H.descendants(edges(spark, GRAPHS["chain"]))
    assert len(rounds) <= 8


def random_sets():
    rng = random.Random(3)
    names = [f"l{i:03d}" for i in range(150)]
    pairs = [(names[rng.randrange(max(1, i // 3))], names[i]) for i in range(1, 150) for _ in range(2)] + [("l149", "l148")]
    pairs = [p for p in pairs if p[0] != p[1]]
    sets = [(k, rng.choice([*names, "unknown", None])) for k in range(60) for _ in range(rng.randrange(1, 30))] + [(None, "l000"), (None, "l149"), (None, "l149")]
    return pairs, sets


def pruned(pairs, sets):
    above = {}
    for x, _, a in closed(pairs):
        above.setdefault(x, set()).add(a)
    of = {}
    for k, x in sets:
        of.setdefault(k, set()).add(x)
    return {(k, x) for k, xs in of.items() for x in xs if k is None or not any(x in above.get(y, ()) for y in xs)}


@pytest.mark.parametrize("way", ["sets as bits", "bits of ancestors", "pairs"])
def test_pruning_equals_plain_sets(spark, monkeypatch, way):
    if way != "sets as bits":
        monkeypatch.setattr(H, "MOST_LABELS", 0)
    if way == "pairs":
        monkeypatch.setattr(H, "MOST_BITS", 0)
    pairs, sets = random_sets()
    c = H.closure_of_edges(edges(spark, pairs))
    got = H.pseudo_leaves(spark.createDataFrame(sets, "k long, label string"), c, "k").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == pruned(pairs, sets)
    none = spark.createDataFrame([], "k long, label string")
    assert H.pseudo_leaves(none, c, "k").count() == 0
    empty = H.closure_of_edges(edges(spark, []))
    assert {tuple(r) for r in H.pseudo_leaves(spark.createDataFrame(sets, "k long, label string"), empty, "k").collect()} == set(sets)


def test_pruning_a_cycle_keeps_all_or_nothing(spark):
    c = H.closure_of_edges(edges(spark, GRAPHS["cycle below a root"]))
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "x")], "k long, label string")
    assert {tuple(r) for r in H.pseudo_leaves(sets, c, "k").collect()} == {(2, "x")}
    assert {tuple(r) for r in H.pseudo_leaves_or_all(sets, c, "k").collect()} == {(1, "a"), (1, "b"), (2, "x")}


def test_arrays_keep_their_order_and_repeats(spark):
    known = H.ancestry(H.closure_of_edges(edges(spark, GRAPHS["cycle below a root"])))
    rows = [(1, ["x", "a", "x", "r", "new", None]), (2, ["b", "a", "b"]), (3, []), (4, None), (5, ["r", "r"])]
    got = {r.k: r.l for r in H.leaves_of_array(spark.createDataFrame(rows, "k int, l array<string>"), "l", known).collect()}
    assert got == {1: ["x", "x", "new", None], 2: ["b", "a", "b"], 3: [], 4: None, 5: ["r", "r"]}


def test_nested_trees(spark):
    deep = {"name": "d0"}
    for i in range(1, 12):
        deep = {"name": f"d{i}", "children": [deep, {"name": i}, {"children": [{"name": "lost"}]}, "text", None]}
    rows = [json.dumps(deep), json.dumps([{"name": "Cat", "children": [{"name": "Cat"}]}, {"name": "Other", "children": None}]), "no json", None, "3"]
    nodes = H.nodes_of(spark, spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert sorted(r.name for r in nodes) == sorted([*(f"d{i}" for i in range(12)), "Cat", "Cat", "Other"])
    assert len({r.node_id for r in nodes}) == len(nodes) and sum(r.parent_id is None for r in nodes) == 3
    c = H.closure(H.nodes_of(spark, spark.createDataFrame([(r,) for r in rows], "value string")))
    assert {(r.depth, r.ancestor) for r in c.where("label = 'd0'").collect()} == {(12 - i, f"d{i}") for i in range(1, 12)}
    assert {tuple(r) for r in c.where("label = 'Cat'").collect()} == {("Cat", 1, "Cat")}


def test_open_labels_take_the_stand_in(spark):
    c = H.closure_of_edges(edges(spark, [("Entity", "Animal"), ("Animal", "Cat"), ("Entity", "Aircraft")]))
    scores = spark.createDataFrame([(1, "Cat", 0.3), (1, "Animal", 0.9), (2, "Aircraft", 0.4), (2, "Cat", 0.1), (3, "Cat", None), (4, "Dog", 0.5)], "q int, label string, score double")
    truth = spark.createDataFrame([(1, "Cat"), (1, "Animal"), (2, "Animal"), (3, "Cat"), (4, "Dog")], "q int, label string")
    found, empty = L.open_labels(scores, truth, c, "q")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "Cat", 0.3), (2, "Aircraft", 0.4)]
    assert sorted(r.q for r in empty.collect()) == [3, 4]
