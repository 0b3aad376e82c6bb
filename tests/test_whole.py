"""Answers in blocks of any size against SQL, and grounding against plain Python."""

import os
import random
import re

import pytest
from oracle import same
from pyspark.sql import functions as F

from veritab.operators import alike, checkpoints, grounding, placement
from veritab.plans import placing, registry


@pytest.mark.parametrize("name", ["soft_accuracy", "textual_accuracy", "majority_answer", "combined_answers", "prompt_top_answer"])
@pytest.mark.parametrize("block", [65_536, 7])
def test_every_answer_counts(spark, monkeypatch, name, block):
    monkeypatch.setattr("veritab.plans.scoring.BLOCK", block)
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def lines_of_ten(spark, texts):
    """Rows (doc_id, answer, tokens): the words of each text as tokens, ten a line."""
    rows = [(i, answer, [(w, (10 * (k % 10), 20 * (k // 10), 10 * (k % 10) + 8, 20 * (k // 10) + 12)) for k, w in enumerate(t.split())]) for i, answer, t in texts]
    return spark.createDataFrame(rows, "doc_id long, answer string, tokens array<struct<word:string,rect:struct<x0:int,y0:int,x1:int,y1:int>>>")


def test_words_behind_the_fortieth_are_found(spark):
    """Answers are words 2 and 3; after the fortieth they stand again, so boxes reach down to where they do."""
    words = ["w0", "alpha", "beta", *[f"f{i}" for i in range(60)]]
    texts = [(3, "beta", " ".join([*words, "beta", "end"])), (4, "alpha beta", " ".join([*words, "gamma", "alphabeta"])), (6, "beta", " ".join(words))]
    tokens = lines_of_ten(spark, texts)
    got = {r.doc_id: r.match for r in grounding.exact_and_numeric(tokens).collect()}
    assert [(got[i].why, *got[i].rect) for i in (3, 4, 6)] == [("exact_token", 20, 0, 38, 132), ("exact_token", 40, 120, 48, 132), ("exact_token", 20, 0, 28, 12)]
    every = {r.doc_id: r.match for r in grounding.grounded(tokens).collect()}
    assert (every[3].why, every[3].rect.y1) == ("exact_token", 132) and (every[4].why, every[4].rect.y0) == ("exact_token", 120)
    late = {r.doc_id: r.match for r in grounding.grounded(tokens.withColumn("answer", F.lit("end gama"))).collect()}
    assert late[3].rect.y1 == 132


def test_a_question_names_the_best_token_of_each_keyword(spark):
    """One box a keyword without an equal token, numbers of two digits and more, six keywords at most."""
    tokens = lines_of_ten(spark, [(1, "yes", "room rooms 7 42 tower towels seventh sevenths")])
    tokens = tokens.withColumn("t", grounding.normalised_tokens(F.col("tokens")))
    asked = {"which room": [0], "which roomy": [0], "room 42": [0], "number 42x please": [30], "room42 is": [30], "seven7 steps": [], "tower": [40], "one two three four five six tower": [], "the big six and two tower": [40], "sevenths": [70]}
    for question, want in asked.items():
        got = tokens.select(grounding.support_rects(F.col("t"), F.lit(question)).alias("r")).first().r
        assert [r.x0 for r in got] == want, question


def test_largest_box_is_the_last_resort(spark):
    """Only where no phrase has letters and the answer has no keyword; else the first of the least like tokens is taken."""
    rows = [(1, "a b", [("!!", (0, 0, 5, 5)), ("--", (10, 0, 30, 30)), ("..", (40, 0, 60, 30))]), (4, "answer", [("!!", (0, 0, 5, 5)), ("--", (10, 0, 30, 30))]), (2, "answer", [("!!", (5, 5, 5, 5))]), (3, "answer", [])]
    df = spark.createDataFrame(rows, "doc_id long, answer string, tokens array<struct<word:string,rect:struct<x0:int,y0:int,x1:int,y1:int>>>")
    got = {r.doc_id: r.match for r in grounding.grounded(df).collect()}
    assert got[1].why == "largest_box_fallback" and got[1].rect.x0 == 10 and got[2] is None and got[3] is None
    assert (got[4].why, got[4].score, got[4].rect.x0) == ("forced_best_token_fuzzy_best", 0.0, 0)


def test_wide_letters_and_digits_are_found(spark):
    tokens = lines_of_ten(spark, [(1, "Ｒｏｏｍ", "the room"), (2, "room", "the ＲＯＯＭ"), (3, "no ４２ here", "gate 42 b"), (4, "cafe\u0301", "the café")])
    got = {r.doc_id: r.match for r in grounding.exact_and_numeric(tokens).collect()}
    assert [(got[i].why, got[i].rect.x0) for i in (1, 2, 4)] == [("exact_token", 10)] * 3 and got[3].why == "numeric_phrase"


def test_all_words_are_tokens(spark, tables):
    got = placing._tokens(spark, "/root/testdata/sf0.001").agg(F.sum(F.size("tokens"))).first()[0]
    assert got == sum(len(r.text.split()) for r in tables("documents").select("text").collect() if r.text)


IMAGE = "seed int, mode string, w int, h int, tw int, th int, px int, min_px int, max_retry int, margin int, forbidden array<struct<x0:int,y0:int,x1:int,y1:int>>, answer_rect struct<x0:int,y0:int,x1:int,y1:int>"


def put(spark, rows):
    return placement.placed(spark.createDataFrame(rows, IMAGE), F.col("mode")).select("seed", "placement.*").collect()


def test_fonts_shrink_to_the_least_size(spark):
    wall = [(0, 0, 100, 70), (0, 70, 70, 100)]  # leaves 30 by 30 pixels, and cells begin at 72
    rows = [(1, mode, 100, 100, 56, 28, 28, least, 200, 0, wall, (0, 0, 10, 10)) for mode in ("near", "mid", "far") for least in (14, 16)]
    got = put(spark, rows)
    assert sorted((r.reason, r.used_px) for r in got) == [("far", 14), ("forced", 16), ("forced", 16), ("forced", 16), ("mid", 14), ("near", 14)]
    assert all(r.rect.x0 >= 70 and r.rect.y0 >= 70 and r.rect.x1 <= 100 and r.rect.y1 <= 100 for r in got if r.reason != "forced")


def test_random_places_are_tried_max_retry_times(spark):
    wall = [(0, 0, 100, 75), (0, 75, 75, 100)]
    found = lambda tries: sum(r.reason == "random" for r in put(spark, [(i, "random", 100, 100, 10, 10, 28, 14, tries, 0, wall, (0, 0, 10, 10)) for i in range(12)]))
    assert found(0) == 0 and found(20) < 12 and found(400) == 12


def test_texts_stand_anywhere_in_their_cell(spark):
    got = put(spark, [(i, "far", 640, 480, 10, 10, 28, 14, 200, 8, [], (300, 200, 310, 210)) for i in range(12)])
    at = [((r.rect.x0 - 8) % 56, (r.rect.y0 - 8) % 42) for r in got]
    assert len(set(at)) > 6 and all(x <= 46 and y <= 32 for x, y in at)


def _plain_best(said, words, boxed):
    """The phrase most like an answer, by every phrase's whole table of edits and every substring."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    best = None
    for n in range(5, 1, -1):
        for i in range(len(words) - n + 1):
            text = "".join(words[i : i + n])
            if text and "1" in boxed[i : i + n]:
                common = max((m for a in range(len(said)) for m in range(1, len(said) - a + 1) if said[a : a + m] in text), default=0)
                score = min(1.0, 0.6 * (common / len(said)) + (1 - 0.6) * (1 - edits(said, text) / max(len(said), len(text))))
                best = (score, i, n) if best is None or score > best[0] else best
    return best


def test_phrases_most_alike_by_every_phrase():
    """Answers of one to three blocks of 64 letters, empty words, words without boxes, letters beyond 16 bits, ties."""
    rng = random.Random(5)
    word = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    rows = []
    for i in range(150):
        letters = "abé𝔞zq" if i % 2 else "ab"
        words = [word(letters, 0, 7) for _ in range(rng.randint(1, 12))]
        rows.append((word(letters, 1, 10) if i % 3 else word(letters, 50, 140), words, "1" * len(words) if i % 4 else word("01", len(words), len(words))))
    score, at, n = alike.most_alike([r[0] for r in rows], ["\n".join(r[1]) for r in rows], [r[2] for r in rows], 2, 5, 0.6)
    assert [(score[i], at[i], n[i]) if n[i] else None for i in range(len(rows))] == [_plain_best(*r) for r in rows]


def test_words_most_alike_and_their_boxes_as_the_plain_expression_has_them(spark):
    """Empty words, words without boxes, numbers, ties, keywords that a token equals, none at all, and a likeness of 0."""
    rng = random.Random(6)
    word = lambda a, b: "".join(rng.choice("ab7é") for _ in range(rng.randint(a, b)))
    rows = []
    for i in range(200):
        words = [word(0, 4) for _ in range(rng.randint(1, 8))]
        boxes = [(0, 0, 0, 0) if i % 4 == 0 and rng.random() < 0.6 else (10 * k, 0, 10 * k + 8, 12) for k in range(len(words))]
        rows.append((i, [word(1, 5) if rng.random() < 0.9 else "zzz" for _ in range(rng.randint(0, 4))], [{"word": w, "rect": b} for w, b in zip(words, boxes, strict=True)]))
    df = spark.createDataFrame(rows, "i int, words array<string>, tokens array<struct<word:string,rect:struct<x0:int,y0:int,x1:int,y1:int>>>")
    plain = {r.i: r.x for r in df.select("i", grounding.keyword_rects(grounding.normalised_tokens(F.col("tokens")), F.col("words"), 0.6).alias("x")).collect()}
    boxed = ["".join("1" if t["rect"][2] else "0" for t in r[2]) for r in rows]
    near = alike.words_alike([r[1] for r in rows], ["\n".join(t["word"] for t in r[2]) for r in rows], boxed)
    own = df.join(spark.createDataFrame([(r[0], n) for r, n in zip(rows, near, strict=True)], "i int, near array<struct<score:double,at:int>>"), "i")
    words = F.col("tokens")["word"]
    for r in own.select("i", grounding._named_by(F.col("words"), F.col("near"), words, words, F.col("tokens")["rect"], 0.6).alias("x")).collect():
        told = lambda x: (sorted(x.rects), x.best and (x.best.score, x.best.rect))
        assert told(r.x) == told(plain[r.i]), rows[r.i]


def test_few_rows_wait_for_python(spark):
    """Compatibility forms need no Python, and of the one function that does, each row gets its lines: rows that give it nothing would all wait at once, on disk when memory ends."""
    tokens = lines_of_ten(spark, [(i, "beta", "alpha beta cafe\u0301 \ufb01n") for i in range(4)])
    plan = grounding.grounded(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    given = re.search(r"_most_alike\((.*?)\)#", plan).group(1)
    assert re.search(r"(^|, )_lines#\d+,", given), given
    assert [r.match.why for r in grounding.grounded(tokens).collect()] == ["exact_token"] * 4


def test_the_whole_cascade_is_one_pass(spark):
    """No job runs before the rows are asked for, nothing is kept on disk, and an answer that is null is like no phrase."""
    tokens = lines_of_ten(spark, [(1, "beta", "alpha beta"), (2, "alfa betta", "so alpha beta it is"), (3, "zwzwz", "room 42"), (4, None, "room 42")])
    kept = checkpoints.folder(spark).rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(kept))
    df = grounding.grounded(tokens)
    assert set(os.listdir(kept)) == before
    got = {r.doc_id: r.match for r in df.collect()}
    assert set(os.listdir(kept)) == before
    assert [got[i].why for i in (1, 2, 4)] == ["exact_token", "fuzzy_phrase", "largest_box_fallback"] and got[3].why.startswith("forced_best")


def test_highest_answers_with_types_and_values_that_are_null(spark, tmp_path):
    import duckdb

    rows = [(1, None, 9.0), (1, "a", 2.0), (1, "b", 3.0), (2, None, 1.0), (3, "a", None), (3, "b", -1.0), (4, "a", None)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["highest_answer"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.sql(registry.ORACLE_SQL["highest_answer"]).fetchall())
    assert got == [(1, "b", 3), (2, None, 1), (3, "b", 2), (4, None, 1)]
