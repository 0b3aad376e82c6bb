"""Distractors from the inverted index against the rule in plain Python."""

import hashlib
import time

import pytest

from veritab.operators import checkpoints, hierarchy, negatives

CHUNK, SEED = negatives.CHUNK, 42


def md5(*parts):
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def picks(o, y, excluded, vocabulary, closed, root="Entity"):
    """The three labels by reading whole postings."""
    up = {v: {a for l, _, a in closed if l == v} for v in vocabulary}
    at = {v: {(d, a) for l, d, a in closed if l == v and d > 1} for v in vocabulary}
    rooted = [v for v in vocabulary if (v, 1, root) in closed]
    level = max((d for d, _ in at[y]), default=2)
    levels = [level, max(2, level - 1), max(2, level - 2)]
    nodes = [{n for n in at[y] if n[0] == d} for d in levels]
    bands = {"hard": nodes[0], "medium": nodes[1] - nodes[0], "easy": nodes[2] - nodes[1] - nodes[0], "base": {None}}
    order = {}
    for band, own in bands.items():
        ranked = []
        for n in own:
            name = "root" if n is None else f"{n[0]}/{n[1]}"
            members = [x for x in rooted if n is None or n in at[x]]
            chunks = -(-len(members) // CHUNK)
            for x in members:
                step = (int(md5(x)[:8], 16) - int(md5(SEED, o, name)[:8], 16) % chunks) % chunks
                kin = x == y or x in up[y] or y in up[x] or x in (excluded or [])
                near = (band in ("medium", "easy") and at[x] & bands["hard"]) or (band == "easy" and at[x] & bands["medium"])
                if not kin and not near:
                    ranked.append((md5(SEED, o, name), step, md5(SEED, o, x), x))
        order[band] = [x for *_, x in sorted(ranked)]
    out = []
    for tries in (("hard", "medium", "base"), ("medium", "easy", "base"), ("easy", "base")):
        out.append(next((x for b in tries for x in order[b] if x not in out), y))
    return out


def held(spark, edges, vocabulary, asked):
    e = spark.createDataFrame(edges, "parent string, child string")
    closure = hierarchy.closure_of_edges(e)
    closed = {(r.label, r.depth, r.ancestor) for r in closure.collect()}
    index = negatives.label_index(spark.createDataFrame([(v,) for v in vocabulary], "label string"), closure)
    q = spark.createDataFrame(asked, "o long, y_true string, own array<string>, extra string")
    got = negatives.indexed_distractors(q, index, "o", SEED, "own").collect()
    assert sorted((r.o, r.y_true or "", r.extra) for r in got) == sorted((o, y or "", x) for o, y, _, x in asked)
    known = {v for v in vocabulary if v is not None}
    for r in got:
        want = picks(r.o, r.y_true, r.own, known, closed) if r.y_true in known else [r.y_true] * 3
        assert [r.hard, r.medium, r.easy] == want, r
    return got


def test_labels_with_several_parents(spark):
    """Types share brands and brands share names; some labels aren't below the root, some stand above others."""
    edges = [("Entity", f"t{i}") for i in range(4)] + [(f"t{i % 4}", f"b{i % 7}") for i in range(28) if i % 5] + [(f"b{i % 7}", f"n{i}") for i in range(60)] + [(f"b{(i * 3) % 7}", f"n{i}") for i in range(0, 60, 4)]
    edges += [("Other", "o1"), ("o1", "o2")]
    vocabulary = [f"n{i}" for i in range(60)] + [f"b{i}" for i in range(7)] + ["t1", "o1", "o2", "alone", "n1", None]
    asked = [(i, f"n{i % 60}", None if i % 3 else [f"n{j}" for j in range(0, 60, 2)], "x") for i in range(40)]
    asked += [(50, "b1", [], "x"), (51, "t1", None, "x"), (52, "o1", None, "x"), (53, "alone", ["n1"], "x"), (54, "unknown", None, "x"), (55, None, None, "x"), (1, "n1", None, "again"), (1, "n1", None, "again")]
    got = held(spark, edges, vocabulary, asked)
    assert all(len({r.y_true, r.hard, r.medium, r.easy}) == 4 for r in got if r.y_true not in ("unknown", None))


def test_a_crowded_node_is_read_to_its_end(spark):
    """One ancestor holds 300 labels, of which all but two are excluded: they are found, and the true label stands for the third."""
    vocabulary = [f"n{i}" for i in range(300)]
    edges = [("Entity", "t"), *[("t", v) for v in vocabulary]]
    got = held(spark, edges, vocabulary, [(o, "n0", [v for v in vocabulary if v not in ("n7", "n250")], "x") for o in range(5)] + [(9, "n5", vocabulary, "x")])
    assert all({r.hard, r.medium, r.easy} == {"n7", "n250", "n0"} for r in got if r.o < 9)
    assert [(r.hard, r.medium, r.easy) for r in got if r.o == 9] == [("n5", "n5", "n5")]


def test_nothing_asked_and_nothing_known(spark):
    edges = spark.createDataFrame([("Entity", "t"), ("t", "n")], "parent string, child string")
    closed = hierarchy.closure_of_edges(edges)
    some, none = spark.createDataFrame([("n",)], "label string"), spark.createDataFrame([], "label string")
    q = spark.createDataFrame([(1, "n")], "o long, y_true string")
    assert negatives.indexed_distractors(q.limit(0), negatives.label_index(some, closed), "o").count() == 0
    for v in (some, none):
        assert [tuple(r) for r in negatives.indexed_distractors(q, negatives.label_index(v, closed), "o").collect()] == [(1, "n", "n", "n", "n")]


@pytest.mark.parametrize("kept", ["cut", "stored"])
def test_what_is_kept_leaves_no_shuffle_files(spark, kept):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    df = getattr(checkpoints, kept)(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and sorted(r["count"] for r in df.collect()) == [142] * 1 + [143] * 6
