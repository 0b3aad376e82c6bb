"""Operator 13: examples against a plain restatement, and exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import prefix_targets

SCHEMA = "conv_id long, turn long, role string, text string, example string, last string, turns int, loss_start string, header int"
HOSTILE = ["</turn>", "</turn>\n", "### assistant: ", "\\", "\\\\", "\\### Assistant: </turn> ok", "#", "##", "####", "<", "<</turn>", "/turn>", "<\\/turn>", "a:b%3A%", "", "\n", "x", "é😀", "\\c", "$0 $1"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "x", 7, "x", 7) for r in rows], SCHEMA).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    out = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in {r[0] for r in rows}:
        turns = sorted(((low(t), r or "", x or "") for i, t, r, x in rows if i == c), key=lambda y: (y[0], y[1].encode(), y[2].encode()))
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(said), sha(said))
    return out


def some():
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, "user", "and?"), (1, 4, "assistant", "so"), (1, 5, "user", "bye")]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "user", "alone"), (4, 0, "assistant", "first"), (5, None, None, "no role"), (5, 3, "assistant", "x")]
    rows += [(6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (6, 1, "user", "c"), (6, 1, "assistant", "a"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(7, i, HOSTILE[i % len(HOSTILE)] if i % 3 else "assistant", HOSTILE[(i * 7 + i // 20) % len(HOSTILE)] + HOSTILE[i % 13]) for i in range(120)]
    rows += [(8, i, "user" if i % 2 == 0 else "assistant", "w" * (i % 9) + "#" * (i % 4)) for i in range(70)]
    return rows + [(9, 0, "user", "q"), (9, 1, "assistant", "long " * 100_000 + "\\" * 50_000 + "#" * 50_000)]


def test_read_back_equals_the_table(spark):
    rows = some()
    for block, parts in ((512, 3), (16, 1), (1, 5)):
        got = prefix_targets.examples(frame(spark, rows, parts), turns_per_block=block)
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in prefix_targets.read_back(got).collect()} == wanted(rows)


def test_examples_hold_what_came_before(spark):
    got = prefix_targets.examples(frame(spark, [r for r in some() if r[0] in (1, 3, 4)])).collect()
    by = {(r.conv_id, r.example): r for r in got}
    assert sorted(by) == [(1, 3), (1, 5), (1, 6), (3, 1), (4, 1)]
    turns = ["### system: be kind</turn>\n", "### user: hi</turn>\n", "### assistant: ho</turn>\n", "### user: and?</turn>\n", "### assistant: so</turn>\n", "### user: bye</turn>\n"]
    assert by[1, 3].text == "".join(turns[:3]) and by[1, 5].text == "".join(turns[:5]) and by[1, 6].text == "".join(turns)
    loss = {k: r.text[r.loss_start : r.loss_end] for k, r in by.items()}
    assert loss == {(1, 3): "ho", (1, 5): "so", (1, 6): "", (3, 1): "", (4, 1): "first"}
    assert {k for k, r in by.items() if r["last"]} == {(1, 6), (3, 1), (4, 1)}


def test_marks_never_come_from_texts(spark):
    got = prefix_targets.conversations(frame(spark, some())).collect()
    for r in got:
        for t in r.turns:
            assert "</turn>" not in t.text + t.header and "##" not in t.text and "##" not in t.header[4:]


def test_no_rows(spark):
    assert prefix_targets.examples(frame(spark, [])).collect() == []
    assert prefix_targets.read_back(prefix_targets.examples(frame(spark, []))).collect() == []


def test_long_conversations_are_dealt(spark):
    """A conversation with most of all rows: its examples come from several tasks."""
    from pyspark.sql import functions as F

    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(900)] + [(2, 0, "user", "x")]
    got = prefix_targets.examples(frame(spark, rows), turns_per_block=50).where("conv_id = 1").withColumn("p", F.spark_partition_id())
    assert got.count() == 450 and got.select("p").distinct().count() > 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", *HOSTILE]), st.lists(st.sampled_from(HOSTILE), max_size=5).map("".join)), min_size=1, max_size=12))
def test_any_conversation_comes_back(spark, turns):
    rows = [(1, i, r, x) for i, (r, x) in enumerate(turns)]
    got = prefix_targets.read_back(prefix_targets.examples(frame(spark, rows, 1))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == wanted(rows)[1]
