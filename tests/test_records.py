"""Operators of the records queries against plain Python, and functions on workers that lack this package."""

import json
import math
import os
import subprocess
import sys
import time

import numpy as np
import pytest
from oracle import SF
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veritab.functions import parsing, prompts, textnorm
from veritab.operators import models, placement
from veritab.plans import registry
from veritab.sources import images, readers


def test_staged_search_keeps_its_rules(spark):
    """Every place found fits a text's proportions or its whole region, meets no forbidden box, keeps the distance of its stage; a forced one had no place in either stage."""
    from veritab.plans import records

    rows = {r.k: r for r in records._mask_rows(spark, SF).collect()}
    got = {r.k: r for r in registry.QUERIES["staged_placements"](spark, SF).collect()}
    assert set(got) == set(rows) and {r.reason for r in got.values()} >= {"stage 1", "force_top_left"}
    for k, r in got.items():
        box, avoid, least = rows[k].box, (30, 20, 45, 35) if k % 2 == 0 else None, k % 4 * 12
        assert 0 <= r.x0 < r.x1 <= 80 and 0 <= r.y0 < r.y1 <= 60
        if r.reason == "force_top_left":
            continue
        assert not (r.x0 < box.x1 and box.x0 < r.x1 and r.y0 < box.y1 and box.y0 < r.y1)
        if avoid:
            gap = math.hypot(max(0, avoid[0] - r.x1, r.x0 - avoid[2]), max(0, avoid[1] - r.y1, r.y0 - avoid[3]))
            assert gap >= (least if r.reason == "stage 1" else min(least, 80 / 3))


def test_staged_search_by_hand(spark):
    none, grid = "CAST(NULL AS struct<x0:int,y0:int,x1:int,y1:int>)", [[True] * 40, [c < 4 for _ in range(5) for c in range(8)]]
    base = spark.createDataFrame([(1, grid)], "id int, masks array<array<boolean>>").selectExpr("masks", "80 AS w", "50 AS h", "8 AS cols", "array(array(20.0D, 10.0D)) AS sizes")
    rect = lambda *v: F.struct(*[F.lit(x).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])

    def place(position=1, preferred=None, forbidden=(), avoid=None, distance=0.0):
        own = base.withColumns({"position": F.lit(position), "preferred": rect(*preferred) if preferred else F.expr(none), "forbidden": F.array(*[rect(*f) for f in forbidden]).cast("array<struct<x0:int,y0:int,x1:int,y1:int>>"), "avoid": rect(*avoid) if avoid else F.expr(none), "distance": F.lit(distance)})
        return tuple(placement.staged_places(own).select("place.*").first())

    assert place() == (0, 5, 80, 45, "stage 1")  # the whole image, cut to two by one
    assert place(position=2) == (0, 5, 40, 25, "stage 1")  # four by three cells are the largest that are wider than high, cut to two by one
    assert place(preferred=(10, 10, 30, 20)) == (10, 10, 30, 20, "stage 1")
    assert place(preferred=(10, 10, 30, 20), forbidden=[(0, 0, 80, 50)])[4] == "force_top_left"
    assert place(avoid=(60, 40, 70, 50), distance=5.0, preferred=(10, 10, 30, 20)) == (10, 10, 30, 20, "stage 1")
    assert place(avoid=(60, 10, 70, 20), distance=40.0, preferred=(10, 10, 30, 20))[4] == "stage 2"  # 30 pixels away, a third of 80 asked


def test_structured_answers(spark):
    rows = [('{"word": "a", "place": 2}',), ('{"word": "a"}',), ("[1]",), ("no",), (None,), (' {"word": "a", "place": "x"}',)]
    got = spark.createDataFrame(rows, "t string").select(parsing.structured(F.col("t"), "word string, place int").alias("p")).select("p.value.word", "p.reason").collect()
    assert [tuple(r) for r in got] == [("a", "ok"), (None, "missing place"), (None, "no_json"), (None, "no_json"), (None, "no_json"), (None, "missing place")]


def test_models_that_hang_or_fail_say_why(spark):
    def slow():
        def answer(asked):
            if asked[0] == "wait":
                time.sleep(3)
            return asked[:-1] if asked[0] == "few" else asked

        return answer

    df = spark.createDataFrame([("go",), ("wait",), ("few",)], "p string").coalesce(1)
    got = {r.p: (r.response, r.why) for r in models.generated(df, slow, "p", batch=1, timeout=0.5, reason="why").collect()}
    assert got == {"go": ("go", None), "wait": (None, "TimeoutError"), "few": (None, "ValueError")}
    assert models.generated(df, slow, "p", batch=1).columns == ["p", "response"]


def test_late_calls_are_killed(spark, tmp_path):
    """A call over the limit leaves no process behind, one that ends its process says so, and calls within the limit answer."""
    path = str(tmp_path / "pids")

    def odd():
        import os

        def answer(asked):
            with open(path, "a") as f:
                f.write(f"{os.getpid()}\n")
            if asked[0] == "wait":
                time.sleep(600)
            if asked[0] == "end":
                os._exit(3)
            if asked[0] == "raise":
                raise KeyError("x")
            return ["y" * 300_000] if asked[0] == "long" else asked

        return answer

    df = spark.createDataFrame([(p,) for p in ("go", "wait", "end", "raise", "long", "on")], "p string").coalesce(1)
    start = time.time()
    got = {r.p: (r.response, r.why) for r in models.generated(df, odd, "p", batch=1, retries=1, timeout=1.0, reason="why").collect()}
    assert time.time() - start < 60
    assert got.pop("long") == ("y" * 300_000, None)
    assert got == {"go": ("go", None), "on": ("on", None), "wait": (None, "TimeoutError"), "end": (None, "ProcessEnded"), "raise": (None, "KeyError")}
    pids = [int(p) for p in open(path).read().split()]
    assert len(pids) == len(set(pids)) == 9
    for pid in pids:
        with pytest.raises(ProcessLookupError):
            os.kill(pid, 0)


def test_texts_are_encoded_in_chunks(spark):
    sizes = []

    def counted():
        def encode(texts):
            assert len(texts) <= 3
            return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

        return encode

    df = spark.createDataFrame([(1, ["a", "bb"]), (2, []), (3, ["c"] * 5)], "id int, texts array<string>").coalesce(1)
    got = {r.id: r.vectors for r in models.encoded(df, counted, "texts", chunk=3).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 2, 2: 0, 3: 5} and np.allclose(got[3], [0.6, 0.8]) and not sizes


def test_the_ensemble_has_eighty_templates(spark):
    assert len(set(prompts.ENSEMBLE)) == 80 and all(t.count("{}") == 1 for t in prompts.ENSEMBLE)
    got = spark.range(1).select(prompts.label_prompts(F.lit("sea_lion"), prompts.ENSEMBLE).alias("p")).first().p
    assert got[0] == "a bad photo of a sea lion." and got[-1] == "a tattoo of the sea lion."


@pytest.mark.parametrize("f", [parsing.balanced])
def test_functions_travel_without_the_package(f, tmp_path):
    """A worker that can't import this package runs its functions."""
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(f))
    call = "f('a {b} c')"
    code = f"import sys; sys.path[:] = [p for p in sys.path if 'repo' not in p]; from pyspark import cloudpickle; f = cloudpickle.loads(open({str(tmp_path / 'f.pkl')!r}, 'rb').read()); print({call}); assert 'veritab' not in sys.modules"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "['{b}']"


def test_longest_common_substrings_of_odd_texts(spark):
    rows = [("abcde", "xbcdy"), ("", "a"), ("a", ""), (None, "a"), ("é" * 3, "aéé"), ("ab" * 400, "ba" * 300), ("x", "y"), ("a\x00b", "a\x00b")]

    def plain(a, b):
        return max((len(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0) if a and b else 0

    want = [plain(a, b) if not a or len(a) < 50 else 600 for a, b in rows]
    got = [r.n for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(textnorm.longest_common(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == want


def test_only_small_tables_of_few_files_are_dealt_out(spark, tables, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    one = tables("documents")
    assert readers.dealt(one).rdd.getNumPartitions() == cores
    monkeypatch.setattr(readers, "SMALL_BYTES", 10)
    assert readers.dealt(one) is one


def test_one_file_per_image_with_its_records(spark, tmp_path):
    """Rows without an image, without an id, of one id or of one file name; answers as they come; a second run gives the same files."""
    rows = [
        (0, b"a", "x", "q0", ["1", " ", None, " two "]), (1, b"b", "x", None, []), (2, None, "gone", "q2", None), (3, b"", None, "q3", None), (4, b"d", "x.jpg", "q4", ["d"]),
        (5, b"e", "../up/p.PNG", "q5", ["e"]), (6, b"f", "", "q6", ["f"]), (7, b"g" * 100_000, "50% ünder.webp", "q7", ["g"]),
    ]
    df = spark.createDataFrame(rows, "row_no long, image binary, image_id string, question string, answers array<string>")
    path = str(tmp_path / "out")
    for part in (df.repartition(5), df.coalesce(1)):
        images.export_images(part, path)
        files = {f: (tmp_path / "out" / "images" / f).read_bytes() for f in os.listdir(f"{path}/images") if not f.startswith((".", "_"))}
        assert files == {"x.jpg": b"a", "idx_3.jpg": b"", "%2E.%2Fup%2Fp.PNG": b"e", "idx_6.jpg": b"f", "50%25 ünder.webp": b"g" * 100_000}
        assert json.loads((tmp_path / "out" / "images" / "_SUCCESS").read_text()) == {"files": 5, "bytes": 100_003}
    got = {r.row_no: r for r in spark.read.json(f"{path}/records").collect()}
    assert sorted(got) == [0, 1, 3, 4, 5, 6, 7]
    assert [got[i].answer for i in (0, 1, 3, 4)] == ["1, two", "", "", "d"] and [got[i].image_id for i in (0, 3, 6)] == ["x", "idx_3", "idx_6"]
    assert [got[i].image for i in (0, 1, 4)] == ["x.jpg"] * 3 and got[5].question_id == 5 and got[0].text == "q0" and got[1].text is None
    images.export_images(df.limit(0), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "images" / "_SUCCESS").read_text()) == {"files": 0, "bytes": 0}


def test_export_keeps_given_answers(spark):
    df = spark.createDataFrame([(0, b"a", "kept", 9)], "row_no long, image binary, answer string, question_id int")
    assert images.image_records(df).select("image", "answer", "question_id", "text").first() == ("idx_0.jpg", "kept", 9, None)
    assert images.image_records(df.drop("answer").withColumn("answers", F.lit("one"))).first().answer == "one"
    assert images.image_records(df.drop("answer")).first().answer == ""
