"""Evaluation and training records from tables of questions and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import prompts


def conversations(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, messages): each conversation's turns in order as messages."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("_t")).select(
        key, F.transform("_t", lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content"))).alias("messages")
    )


def last_turns(turns: DataFrame, key: str, turn: str, text: str) -> DataFrame:
    """(key, text) of each conversation's last turn (P19): a partial aggregate, no ordering of turns."""
    return turns.groupBy(key).agg(F.max_by(text, turn).alias(text))


def evaluation_rows(df: DataFrame, task: str) -> DataFrame:
    """The columns that a task is scored by (P07). ``answers`` may be an array or one ``answer``, but the same in all rows."""
    shared = ["sample_idx", "question_id", "image_id", "question"]
    if task == "obj_mc":
        return df.select(*shared, F.array("choices.A", "choices.B", "choices.C", "choices.D").alias("choices"), F.col("answer").cast("string").alias("answer"))
    if task == "obj_oe":
        return df.select(*shared, "answer2score", "attack_word")
    one, many = "answer" in df.columns, "answers" in df.columns
    if not one and not many:
        raise ValueError("neither answer nor answers")
    mixed = F.count_if(F.col("answers").isNull() & F.col("answer").isNotNull()) if one and many else F.lit(0)
    if one and many and df.agg((mixed > 0) & (F.count_if(F.col("answers").isNotNull()) > 0)).first()[0]:
        raise ValueError("some rows have answers and others only answer")
    return df.select(*shared, F.coalesce(*([F.col("answers")] if many else []), *([F.array("answer")] if one else [])).alias("answers"))


def with_turns(df: DataFrame, task: str, strategy: str) -> DataFrame:
    """``df`` with the user turns of a prompt strategy."""
    return df.withColumn("turns", prompts.turns(F.lit(task), F.col("question"), F.lit(strategy)))


def union(*tables: DataFrame) -> DataFrame:
    """All rows by column names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def training_messages(df: DataFrame, kind: str, model: str) -> DataFrame:
    """``df`` (question, answer, image) with ``messages``; a model family may want an end mark."""
    eos = "</s>" if "llava" in model.lower() else ""
    return df.where(prompts.record_kind(F.col("split"), F.col("subset")) == kind).withColumn("messages", prompts.chat(F.array("question"), F.array("answer"), F.col("image"), eos))


def assembled_choices(questions: DataFrame, mcq: DataFrame, attack_meta: DataFrame, level: str, seed: int = 42) -> DataFrame:
    """The multiple-choice set of an attack level: options in hashed order, the letter of the answer, the question and the attack word."""
    from veritab.operators.sampling import shuffled

    joined = questions.join(mcq, "question_id").join(attack_meta, "question_id", "left")
    options = shuffled(F.array("answer", "hard", "medium", "easy"), seed, F.col("question_id"))
    joined = joined.withColumn("_o", options)
    letter = prompts_letter(F.array_position("_o", F.col("answer")))
    word = prompts.attack_word(F.lit(level), F.col("answer"), {n: F.col(n) for n in ("hard", "medium", "easy")})
    return joined.select(
        "question_id", "image_id", prompts.choice_question(*[F.col("_o")[i] for i in range(4)]).alias("question"), letter.alias("answer"), F.struct(*[F.col("_o")[i].alias("ABCD"[i]) for i in range(4)]).alias("choices"), word.alias("attack_word"), "meta"
    )


def prompts_letter(position):
    return F.chr(position + 64)


def request(texts: list, images: list, image_first: bool = True, captions: bool = False):
    """Ordered parts of a request: images before or after the texts, each perhaps behind its number (§2.12)."""
    shown = [p for i, image in enumerate(images) for p in ([prompts.part("text", F.lit(f"Image {i + 1}"))] if captions else []) + [prompts.part("image", image)]]
    said = [prompts.part("text", t) for t in texts]
    return F.array(*(shown + said if image_first else said + shown))
