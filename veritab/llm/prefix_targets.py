"""Chat formatting by prefix-target expansion (operator 13).

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply under the loss
mask. Turns behind the last reply, and conversations without one, go out as one more row without a target, so the output
holds every turn.

A turn reads ``### role: text</turn>`` and a line's end. In texts and roles a backslash goes before every backslash, before every
``#`` that follows another and between ``<`` and ``/turn>``; roles spell ``:`` and ``%`` as ``%3A`` and ``%25`` besides. So neither ``##`` nor ``</turn>`` ever
comes from a text, a formatted conversation falls into turns at its end marks alone, and both escapes are undone exactly.

An example is one text and so one row of the size of its conversation up to the reply; a conversation's turns are
gathered once, and its examples are written row by row from there, so a task holds one conversation and one example at a time.
Conversations of more than ``TURNS_PER_BLOCK`` turns are dealt to several tasks, each of which writes the examples of so many turns.

Defined results: turns go in the order of (turn, role, text), nulls first, so ties and repeated rows have an order that doesn't
depend on partitions; repeated rows are turns of their own. A null text is an empty one, and so is a null role. Rows with a null
conversation id form one conversation with that id. An empty table gives no examples. Columns beside those
named don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._session import shuffle_partitions

END = "</turn>\n"
#: Turns whose examples one task writes before others take part.
TURNS_PER_BLOCK = 512


def escaped(text: Column) -> Column:
    """The text with a backslash before all that could be read as a mark of the template."""
    return F.regexp_replace(text, r"\\|(?<=#)#|(?<=<)/(?=turn>)", r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit("### "), escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))), F.lit(": "))


def turns_read(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.filter(F.split(text, END), lambda x: x != "")
    spelled = lambda x: unescaped(F.substring_index(F.substr(x, F.lit(5)), ":", 1))
    role = lambda x: F.replace(F.replace(spelled(x), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    return F.transform(pieces, lambda x: F.struct(role(x).alias("role"), unescaped(F.substr(x, F.instr(x, ":") + 2)).alias("text")))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, each as its header, its escaped text and whether it is a reply."""
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    rows = turns.select(turns[conv_col].alias("conv_id"), F.struct(turns[turn_col].alias("turn"), role.alias("role"), text.alias("text")).alias("_turn"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return ordered.select("conv_id", F.transform("_turns", lambda t: F.struct(header(t["role"]).alias("header"), escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("reply"))).alias("turns"))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """conv_id, example (the number of turns it holds), text, loss_start, loss_end (code points of the text under the loss mask; equal where no reply is), last (whether all of the conversation's turns are in it)."""
    whole = conversations(turns, conv_col, turn_col, role_col, text_col)
    many = F.size("turns")
    short = whole.where(many <= turns_per_block).withColumn("_first", F.lit(1)).withColumn("_until", F.size("turns"))
    blocks = whole.where(many > turns_per_block).withColumn("_first", F.explode(F.sequence(F.lit(1), many, F.lit(turns_per_block))))
    blocks = blocks.withColumn("_until", F.least(F.col("_first") + turns_per_block - 1, many))
    blocks = blocks.repartition(shuffle_partitions(turns.sparkSession), "conv_id", "_first")  # a given number: what is read is small, what is written isn't

    def written(rows: DataFrame) -> DataFrame:
        targets = F.filter(F.sequence("_first", "_until"), lambda k: (k == F.size("turns")) | F.get(F.col("turns"), k - 1)["reply"])
        rows = rows.select("conv_id", "turns", F.explode(targets).alias("example"))
        reply = F.get(F.col("turns"), F.col("example") - 1)
        before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example") - 1), lambda t: F.concat(t["header"], t["text"], F.lit(END))), "")
        rows = rows.select("conv_id", "example", F.concat(before, reply["header"]).alias("_context"), reply["text"].alias("_text"), reply["reply"].alias("_reply"), (F.col("example") == F.size("turns")).alias("last"))
        start = F.char_length("_context")
        masked = F.when(F.col("_reply"), F.char_length("_text")).otherwise(0)
        return rows.select("conv_id", "example", F.concat("_context", "_text", F.lit(END)).alias("text"), start.alias("loss_start"), (start + masked).alias("loss_end"), "last")

    return written(short).unionByName(written(blocks))


def read_back(rows: DataFrame) -> DataFrame:
    """Of each conversation, from its examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = turns_read(F.col("text"))
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.substr(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    one = rows.select("conv_id", "example", F.when(F.col("last"), said).alias("_turns"), unescaped(masked).alias("_loss"), F.char_length("text").cast("long").alias("_chars"))
    one = one.select("conv_id", "example", F.size("_turns").alias("_n"), F.sha2(spoken.cast("binary"), 256).alias("_sha"), "_loss", "_chars")
    whole = one.groupBy("conv_id").agg(
        F.max("_n").cast("long").alias("n_turns"), F.max("_sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "_loss"))).alias("_losses"), F.sum("_chars").alias("formatted_chars")
    )
    loss = F.array_join(F.col("_losses")["_loss"], "")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def hostile(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are full of control strings."""
    said = r"\### Assistant: </turn> ok"
    return spark.range(2, numPartitions=1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
