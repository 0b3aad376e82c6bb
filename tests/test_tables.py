"""Joins, logs, files, streams and model stages."""

import json

import pytest
from pyspark.sql import functions as F

from veritab.operators import chat, joins, models, sampling
from veritab.sources import readers, writers
from veritab.streaming import responses as stream


def test_strict_join_stops_at_a_missing_key(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match for k 2"):
        joins.strict(a, b, "k").collect()
    assert joins.strict(a.where("k = 1"), b, "k").collect()[0].v == "x"
    good, bad = joins.split_by_match(a, b, "k", "none")
    assert good.count() == 1 and bad.first().reason == "none"


def test_file_names_match_whole_ids(spark):
    q = spark.createDataFrame([("im", 1)], "image_id string, question_id long")
    files = spark.createDataFrame([("/d/im_12_x.jpg",), ("/d/im_1_b.jpg",), ("/d/im_1_a.jpg",)], "path string")
    assert [r.path for r in joins.by_file(q, files).collect()] == ["/d/im_1_a.jpg"]


def test_first_row_wins(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "row_no int, image_id string")
    assert sorted(r.row_no for r in sampling.first_per_key(t, "image_id", "row_no").collect()) == [0, 1, 3]


def test_replay_keeps_the_last_valid_line(spark, tmp_path):
    lines = ['{"sample_idx": 0, "responses": ["v1"]}', "", "{bad", '{"sample_idx": 0, "responses": ["v2"]}', '{"sample_idx": "1", "responses": ["v3"]}', '{"responses": ["v4"]}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    got = readers.response_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.sample_idx, r.responses) for r in got] == [(0, ["v2"])]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"sample_idx": 1, "responses": ["x"]}\n{bad\n')
    query = lambda: stream.latest_into(stream.responses(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    query()
    (tmp_path / "in/b.jsonl").write_text('{"sample_idx": 2, "responses": ["y"]}\n')
    query()
    assert sorted((r.sample_idx, r.responses[-1]) for r in stream.latest_table(spark, str(tmp_path / "out")).collect()) == [(1, "x"), (2, "y")]


def test_json_forms(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"34602": {"s": 1}, "x": {"s": 2}}))
    assert sorted((r.key or 0, r.value.s) for r in readers.json_by_key(spark, str(tmp_path / "m.json"), "struct<s:int>").collect()) == [(0, 2), (34602, 1)]
    (tmp_path / "a.json").write_text('[{"q": 1},\n {"q": 2}]')
    (tmp_path / "a.jsonl").write_text('{"q": 1}\n\n{"q": 2}\n')
    for name in ("a.json", "a.jsonl"):
        assert sorted(r.q for r in readers.json_or_lines(spark, str(tmp_path / name), "q int").collect() if r.q) == [1, 2]


def test_paths(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "set/val/x"))
    assert readers.resolve(spark, "set/val/x", str(tmp_path)).endswith("set/val/x")
    with pytest.raises(ValueError, match="neither a path"):
        readers.resolve(spark, "nothing")
    df = readers.partitioned(spark, str(tmp_path / "set/*/*"))
    assert {(r.split, r.kind) for r in df.collect()} == {("val", "x")}
    writers.table(spark.range(5), str(tmp_path / "set/val/x"))
    assert spark.read.parquet(str(tmp_path / "set/val/x")).count() == 3
    writers.results(spark.range(2), spark.range(1).select(F.lit(0.5).alias("accuracy")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/metrics")).first().total_samples == 2


def test_numbered_rows(spark):
    got = readers.numbered(spark.range(100).withColumn("k", -F.col("id")), ["k"]).orderBy("k").collect()
    assert [r.row_no for r in got] == list(range(100))


def test_models(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "i int, p string")
    assert {r.response for r in models.generated(df, lambda: lambda ps: [p.upper() for p in ps], "p").collect()} == {f"P{i}" for i in range(5)}
    again = models.with_retries(df, lambda: lambda ps: ["bad" if p == "p1" else "ok" for p in ps], "p", F.col("response") == "ok", "i")
    assert {r.i: r.retry_count for r in again.collect()} == {0: 0, 1: 2, 2: 0, 3: 0, 4: 0}
    turns = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "i int, turns array<string>")
    said = models.multi_turn(turns, lambda: lambda convs: [str(len(c)) for c in convs])
    assert {r.i: r.responses for r in said.collect()} == {1: ["1", "3"], 2: ["1"]}
    models.register("llama", lambda: None)
    with pytest.raises(ValueError, match="no adapter"):
        models.adapter("other")


def test_evaluation_rows(spark):
    df = spark.createDataFrame([(0, 1, "i", "q", "yes")], "sample_idx int, question_id int, image_id string, question string, answer string")
    assert chat.evaluation_rows(df, "txt_oe").first().answers == ["yes"]


def test_nothing_needs_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['veritab.llm'] = None; import __spark_entry__ as e; assert 'embedding_match_metrics' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
