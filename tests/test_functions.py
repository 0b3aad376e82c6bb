"""Column functions against expected values and plain restatements in Python."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions import choice, geometry, metrics, parsing, prompts, textnorm
from veritab.operators import hierarchy, labels, sampling


def value(spark, column, **named):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in named.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "index"),
    [("I think the answer is (A).", 0), ("The correct choice is Koala.", 2), ("A.", 0), ("It is a dog", 0), ("Answer: banana", 1), ("choose dog", 3), ("nothing", None), ("", None), ("[c] maybe", 2), ("(z) or (b)", 1)],
)
def test_choice_of_a_response(spark, text, index):
    assert value(spark, choice.predicted_choice(F.col("s"), F.col("c"), 4), s=text, c=["Dog", "Cat", "Koala", "Bear"]) == index


@pytest.mark.parametrize(("text", "form"), [("Two dogs.", "2 dogs"), ("The cat's hat", "cat 's hat"), ("isnt it", "isn't it"), ("c-b", "c b"), ("x, y", "x y"), ("3.5", "3.5"), ("", ""), ("the", "")])
def test_consensus_form(spark, text, form):
    assert value(spark, textnorm.consensus_norm(F.col("s")), s=text) == form


def test_seed(spark):
    s = textnorm.seed_of(F.lit("003a8ae2ef43b901"), F.lit("val"), F.lit("val_rc"), F.lit("hash(image_id + pattern_id)"))
    assert value(spark, s) == 161075056


@pytest.mark.parametrize("n", range(1, 13))
def test_soft_score_is_the_mean_over_left_out_answers(spark, n):
    rows = spark.range(n + 1).select(F.col("id").alias("m"), metrics.soft_score(F.lit(n), F.col("id")).alias("s")).collect()
    for r in rows:
        flags = [True] * r.m + [False] * (n - r.m)
        want = sum(min(1, sum(flags[:i] + flags[i + 1 :]) / 3) for i in range(n)) / n
        assert math.isclose(r.s, want, abs_tol=1e-12)


def test_soft_score_of_one_answer_is_zero(spark):
    assert value(spark, metrics.soft_accuracy(F.col("a"), F.col("p")), a=["cat"], p="cat") == 0.0
    assert math.isclose(value(spark, metrics.soft_accuracy(F.col("a"), F.col("p")), a=["x"] * 3 + ["y"] * 7, p="x"), 0.9)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aA1 .,-_/\t\n?!éß", max_size=12), min_size=1, max_size=20))
def test_choice_form_equals_python(spark, texts):
    got = [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", textnorm.choice_norm(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [re.sub(r"[^a-z0-9 ]+", "", " ".join(t.lower().split())) for t in texts]


def rect(x0, y0, x1, y1):
    return geometry.rect(*map(F.lit, (x0, y0, x1, y1)))


def test_touching_rectangles_do_not_intersect(spark):
    assert value(spark, geometry.intersects(rect(0, 0, 2, 2), rect(2, 0, 4, 2))) is False
    assert value(spark, geometry.intersects(rect(0, 0, 3, 2), rect(2, 0, 4, 2))) is True


def test_distances(spark):
    assert value(spark, geometry.corner_distance(rect(0, 0, 4, 4), rect(2, 2, 6, 6), F.lit(10), F.lit(10))) == 0.0
    assert value(spark, geometry.gap_distance(rect(0, 0, 2, 2), rect(5, 6, 7, 8))) == 5.0
    assert value(spark, geometry.clipped(rect(-5, -5, -1, 3), F.lit(10), F.lit(10))) is None


def test_tile_boxes(spark):
    boxes = value(spark, geometry.tile_boxes(geometry.tile_ratio(F.lit(900), F.lit(450))))
    assert len(boxes) >= 2 and (boxes[0].x0, boxes[0].y0) == (0, 0) and boxes[1].x0 == 448


@pytest.mark.parametrize(("text", "word"), [("Sure! {'Misleading': 'Dark  Green',}", "dark green"), ('{"misleading": "X"}', "x"), ("misleading: Red car", "red car"), ("nothing", None), ('{"other": 1}', None), ("{bad", None)])
def test_word_of_generated_text(spark, text, word):
    assert value(spark, parsing.json_field(F.col("s"), "misleading"), s=text) == word


def test_balanced_blocks():
    assert parsing.balanced('a {"b": {"c": 1}} {d} {e') == ['{"b": {"c": 1}}', "{d}"]


def test_prompts(spark):
    t = value(spark, prompts.turns(F.lit("txt_oe"), F.col("q"), F.lit("2phase-focus")), q="What? Answer the question using a single word or phrase.")
    assert len(t) == 2 and t[0].endswith("question. What?") and t[1].startswith("Solve")
    with pytest.raises(Exception, match="unknown strategy"):
        value(spark, prompts.turns(F.lit("txt_oe"), F.col("q"), F.lit("x")), q="What?")
    assert value(spark, prompts.model_name(F.lit("runs/a/checkpoint-7/"))) == "a_checkpoint-7"
    messages = value(spark, prompts.chat(F.array(F.lit("q1"), F.lit("q2")), F.array(F.lit("a1"), F.lit("a2")), F.lit("img"), "</s>"))
    assert [len(m.content) for m in messages] == [2, 1, 1, 1] and messages[1].content[0].text == "a1</s>"


def test_hierarchy_of_a_tree(spark):
    tree = '{"name": "Entity", "children": [{"name": "Animal", "children": [{"name": "Cat", "children": [{"name": "Tabby"}]}, {"name": "Dog"}]}, {"name": 3}]}'
    nodes = hierarchy.nodes_of(spark, tree)
    closed = hierarchy.closure(nodes)
    rows = {(r.label, r.depth): r.ancestor for r in closed.collect()}
    assert {d: a for (l, d), a in rows.items() if l == "Tabby"} == {1: "Entity", 2: "Animal", 3: "Cat"}
    assert not [1 for l, _ in rows if l == "Entity"]
    sets = spark.createDataFrame([(1, "Animal"), (1, "Cat"), (1, "Dog"), (2, "Animal")], "q int, label string")
    assert sorted((r.q, r.label) for r in hierarchy.pseudo_leaves(sets, closed, "q").collect()) == [(1, "Cat"), (1, "Dog"), (2, "Animal")]
    assert {r.label: r.node_depth for r in hierarchy.depths(sets, closed).collect()} == {"Animal": 2, "Cat": 3, "Dog": 3}
    lines = [r.line for r in hierarchy.tree_lines(hierarchy.edges_of(nodes)).collect()]
    assert lines == ["Entity", "  Animal", "    Cat", "      Tabby", "    Dog"]


def test_a_cycle_ends(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string")
    assert {(r.label, r.descendant) for r in hierarchy.descendants(e).collect()} == {("r", "a"), ("r", "b"), ("a", "b"), ("a", "a"), ("b", "a"), ("b", "b")}


def test_score_filters(spark):
    s = spark.createDataFrame([("x", [("a", 0.1), ("b", 0.15)]), ("y", [("a", 0.3), ("b", None)]), ("z", [])], "k string, s array<struct<label:string,score:double>>")
    got = {r.k: [x.label for x in r.f] for r in s.select("k", labels.above_or_best(F.col("s")).alias("f")).collect()}
    assert got == {"x": ["b"], "y": ["a"], "z": []}
    flat = spark.createDataFrame([(1, "a", 0.21), (1, "b", 0.15), (1, "c", 0.25), (2, "a", 0.1), (2, "b", 0.15)], "q int, label string, score double")
    assert {r.q: r.labels for r in labels.above_and_best(flat, "q").collect()} == {1: ["a", "c"], 2: ["b"]}


def test_compatible_truth_never_matches(spark):
    closed = spark.createDataFrame([("Cat", 1, "Entity"), ("Cat", 2, "Animal"), ("Dog", 1, "Entity")], "label string, depth int, ancestor string")
    scores = spark.createDataFrame([(1, "Cat", 0.2), (1, "Dog", 0.9)], "q int, label string, score double")
    truth = spark.createDataFrame([(1, "Cat")], "q int, label string")
    assert labels.true_label(scores, truth, closed, "q").first().asDict() == {"q": 1, "y_true": "Cat", "score": 0.2, "reason": "picked_depth>=3"}
    assert labels.true_label(scores, truth, closed, "q", compat=True).first().y_true == "Dog"


def test_cuts_round_halves_to_even(spark):
    c = value(spark, sampling.tertile_cuts(F.col("v")), v=[3.0, 1.0, 2.0, 4.0])
    assert (c.low, c.first, c.second, c.high) == (1.0, 2.0, 3.0, 4.0)


def test_distractors_are_distinct_and_not_kin(spark):
    e = spark.createDataFrame([("Entity", "A"), ("Entity", "B"), ("A", "a1"), ("A", "a2"), ("B", "b1"), ("B", "b2"), ("a1", "x"), ("a1", "y"), ("a2", "z")], "parent string, child string")
    closed, names = hierarchy.closure_of_edges(e), e.select(F.col("child").alias("label")).distinct()
    pools = sampling.distractor_pools(names, closed, hierarchy.descendants(e))
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "y", "z", "a1", "b2"])], "q int, y_true string")
    kin = {"x": {"A", "a1", "Entity"}, "a1": {"A", "x", "y", "Entity"}}
    for r in sampling.distractors(q, pools, "q").collect():
        three = {r.hard, r.medium, r.easy}
        assert len(three) == 3 and r.y_true not in three and not three & kin.get(r.y_true, set())
    assert {r.y_true: r.hard for r in sampling.distractors(q, pools, "q").collect()}["x"] == "y"


def test_compatibility_forms_of_all_characters(spark):
    """Every code point alone and between others, marks in any order, syllables in parts, and words of an array."""
    import random
    import sys
    from unicodedata import normalize

    points = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    draw = random.Random(4)
    odd = [c for c in points if normalize("NFKC", c) != c or normalize("NFKD", c) != c][::7] + ["\u0301", "\u0323", "\u1161", "\u11a8", "\u3099", "a", "o"] * 40
    texts = [f"x{c}y" for c in points[:70_000]] + ["".join(points[i : i + 20]) for i in range(0, len(points), 20)] + ["".join(draw.choices(odd, k=8)) for _ in range(3000)] + ["", "plain", "ｗｉｄｅ １０"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, x string").repartition(8)
    for r in df.select("i", textnorm.nfkc(F.col("x")).alias("y")).collect():
        assert r.y == (normalize("NFKC", texts[r.i]) if r.i >= 0 else None), texts[r.i]
    words = ["ｗ", None, "", "e\u0301", "ﬁ x", "a\nb"]
    got = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>").coalesce(1).select(textnorm.nfkc_words(F.col("w")).alias("f")).collect()
    assert [r.f for r in got] == [["w", None, "", "é", "fi x", "a b"], [], None]


def brute_rectangle(grid):
    best = 0
    for y in range(len(grid)):
        for x in range(len(grid[0])):
            for h in range(1, len(grid) - y + 1):
                for w in range(h + 1, len(grid[0]) - x + 1):
                    if all(grid[b][a] for b in range(y, y + h) for a in range(x, x + w)):
                        best = max(best, w * h)
    return best


def test_widest_rectangle_of_a_mask(spark):
    """Random masks of many shapes; among equal areas the one that ends first, by line, column and height."""
    import random

    from veritab.functions import masks

    draw = random.Random(5)
    grids = [[[draw.random() < p for _ in range(c)] for _ in range(r)] for p in (0.5, 0.8, 0.95, 1.0, 0.0) for r, c in ((1, 1), (1, 6), (6, 1), (4, 6), (6, 6), (3, 9), (7, 5)) for _ in range(6)]
    df = spark.createDataFrame([(i, [x for line in g for x in line], len(g[0])) for i, g in enumerate(grids)], "i int, m array<boolean>, c int")
    for r in df.select("i", masks.largest_wide_rectangle(F.col("m"), F.col("c")).alias("b")).collect():
        g, (x, y, w, h) = grids[r.i], r.b
        assert w * h == brute_rectangle(g) and (w > h or not w), g
        ends = [(b, a, k) for b in range(1, len(g) + 1) for a in range(1, len(g[0]) + 1) for k in range(1, b + 1) if w and w * h % k == 0 and a - w * h // k >= 0 and w * h // k > k and all(g[p][q] for p in range(b - k, b) for q in range(a - w * h // k, a))]
        assert (y + h, x + w, h) == min(ends, default=(0, 0, 0)), g


def test_masks_and_rectangles(spark):
    from veritab.functions import masks

    row = spark.range(1).select(F.array(*map(F.lit, [True] * 8)).alias("m"), F.lit(4).alias("c"), rect(0, 0, 20, 10).alias("r"), F.lit(40).alias("w"), F.lit(20).alias("h"))
    m, c, r, w, h = map(F.col, "mcrwh")
    got = row.select(masks.largest_wide_rectangle(m, c).alias("a"), masks.without_rects(m, c, F.array("r"), w, h).alias("b"), masks.mask_meets_rect(m, c, r, w, h).alias("d")).first()
    assert tuple(got.a) == (0, 0, 4, 2) and got.b == [False, False, True, True, True, True, True, True] and got.d is True
    odd = row.select(F.array(F.lit(True), F.lit(None).cast("boolean"), F.lit(True), F.lit(True)).alias("m"), F.lit(None).cast("array<boolean>").alias("n"), F.array().cast("array<boolean>").alias("e"), rect(60, 0, 80, 10).alias("out"), "c", "r", "w", "h")
    got = odd.select(masks.largest_wide_rectangle(m, c).alias("a"), masks.largest_wide_rectangle(F.col("n"), c).alias("b"), masks.largest_wide_rectangle(F.col("e"), c).alias("e"), masks.without_rects(m, c, F.array("out"), w, h).alias("f"), masks.without_rects(F.col("n"), c, F.array("r"), w, h).alias("g"), masks.mask_meets_rect(m, c, F.col("out"), w, h).alias("i"), masks.mask_meets_rect(F.col("n"), c, r, w, h).alias("j")).first()
    assert tuple(got.a) == (2, 0, 2, 1) and got.b is None and tuple(got.e) == (0, 0, 0, 0) and got.f == [True, False, True, True] and got.g is None and got.i is False and got.j is None


def test_judges(spark):
    q = "Which? (a) Red Car (b) Blue bus (c)"
    j = lambda answer, correct, dataset: value(spark, parsing.judged(F.lit(answer), F.lit(correct), F.lit(q), F.lit(dataset)))
    assert j("a", "a", "typo_base_x") is True and j("the red car", "a", "typo_base_x") is True and j("blue bus", "a", "typo_base_x") is False and j("blue bus", "b", "typo_base_x") is True
    assert j("It is RED", "red", "vqav2") is True and j("x", "y", "other") is None


def test_square_and_text_regions(spark):
    r = value(spark, geometry.square_region(rect(0, 0, 20, 10), F.lit(100), F.lit(50)))
    assert r.x1 - r.x0 == r.y1 - r.y0 and r.x0 >= 0 and r.y0 >= 0 and r.x1 <= 100 and r.y1 <= 50
    t = value(spark, geometry.text_region(rect(0, 0, 100, 100), F.lit(50), F.lit(10)))
    assert (t.x0, t.y0, t.x1, t.y1) == (0, 40, 100, 60)
    assert value(spark, geometry.layout_prompt(rect(1, 2, 3, 4), F.lit("ab"))) == " l1 t2 r3 b4 [a] [b] <|endoftext|>"
