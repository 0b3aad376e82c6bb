"""Where an answer's text stands among an image's OCR tokens.

Tokens are an array of structs (word, rect) in reading order. An image stays one row and nothing is exchanged: its words are normalised as one text of
lines, each tier of the cascade is a fold over its tokens, and the phrase most like an answer and the tokens most like its words are found for many images at once (``alike``).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.geometry import largest_rect, union_box, valid
from veritab.functions.textnorm import keywords, let, lines_of, nfkc, numbers_in, robust_lines, robust_norm, token_similarity
from veritab.operators.alike import most_alike, words_alike

#: The cascade's defaults, then those of a question's support.
MOST_GRAM, LEAST_GRAM, LEAST_CHARS, LEAST_SCORE, COMMON_WEIGHT, LEAST_TOKEN, LEAST_DIGITS = 5, 2, 2, 0.40, 0.6, 0.6, 2
MOST_KEYWORDS, LEAST_KEYWORD, LEAST_SUPPORT = 6, 3, 0.75
YES_NO = ["yes", "no", "true", "false"]

_RECTS = "array<struct<x0:int,y0:int,x1:int,y1:int>>"


def normalised_tokens(tokens: Column, forms: Column | None = None) -> Column:
    """Tokens with their place, normal form and numbers, the latter two of their compatibility forms where those are given (an array as long)."""
    form = (lambda t, i: F.get(forms, i)) if forms is not None else (lambda t, i: t["word"])
    return F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["word"].alias("word"), robust_norm(form(t, i), False).alias("norm"), numbers_in(form(t, i)).alias("numbers"), t["rect"].alias("rect")))


def _match(rect: Column, why: str, score: Column, at: Column, n: Column) -> Column:
    """A found place."""
    return F.struct(rect.alias("rect"), F.lit(why).alias("why"), score.cast("double").alias("score"), at.cast("int").alias("at"), n.cast("int").alias("n"))


def _run(tokens: Column, at: Column, n: Column) -> Column:
    """The box of n tokens from a place (from 1) on."""
    return union_box(F.transform(F.slice(tokens, at, n), lambda t: t["rect"]))


def _runs(tokens: Column, n: int, test: Callable[[Column, int], Column]) -> Column:
    """The runs of n tokens that pass a test of their first one's place, as structs at, n and rect; only for those is a box made."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    boxed = F.transform(F.filter(starts, lambda i: test(i, n)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _run(tokens, i, F.lit(n)).alias("rect")))
    return F.filter(boxed, lambda g: valid(g["rect"]))


def exact_and_numeric(df: DataFrame, answer: str = "answer", tokens: str = "tokens") -> DataFrame:
    """``df`` with ``match``: short answers are rejected; else all tokens equal to the answer, the first equal phrase from long to short, the last phrase that shares a number of two digits or more (M05, tiers 0 to 3)."""
    return _told(df, answer, tokens).drop("_forms", "_lines", "_norms")


def _told(df: DataFrame, answer: str, tokens: str) -> DataFrame:
    """The same with the answer's forms and numbers, and the tokens' compatibility forms and normal forms as texts of lines."""
    own = df.withColumn("_words", lines_of(F.col(tokens)["word"]))
    own = own.withColumns({"_answer": nfkc(F.col(answer)), "_forms": nfkc(F.col("_words"))}).drop("_words")
    numbers = F.filter(numbers_in(F.col("_answer")), lambda x: F.length(x) >= 2)
    own = own.withColumns({"_said": robust_norm(F.col("_answer"), False), "_numbers": numbers, "_lines": robust_lines(F.col("_forms"))})
    own = own.withColumn("_norms", F.slice(F.split("_lines", "\n"), 1, F.size(tokens)))
    # Most answers equal no token, and most images hold neither the answer's letters in a row nor one of its numbers: boxes and runs are tried for the others only.
    said, norms, all_ = F.col("_said"), F.col("_norms"), F.col(tokens)
    same = F.filter(F.transform(tokens, lambda t, i: F.struct(F.get(norms, i).alias("norm"), t["rect"].alias("rect"))), lambda t: t["norm"] == said)
    own = own.withColumn("_box", F.when((F.length(said) >= LEAST_CHARS) & F.array_contains(norms, said), union_box(F.transform(same, lambda t: t["rect"]))))
    sought = F.col("_box").isNull() & (F.length(said) >= LEAST_CHARS)
    own = own.withColumn("_hits", F.when(sought & (F.size("_numbers") > 0), F.transform(F.split("_forms", "\n"), lambda w: F.arrays_overlap(numbers_in(w), F.col("_numbers")))))
    equal = lambda i, n: F.startswith(said, F.element_at(norms, i)) & (F.array_join(F.slice(norms, i, n), "") == said)
    shares = lambda i, n: F.exists(F.slice("_hits", i, n), lambda hit: hit)
    inside, shared = F.contains(F.replace("_lines", F.lit("\n"), F.lit("")), said), F.exists("_hits", lambda hit: hit)
    own = own.withColumn("_first", F.when(sought & inside, F.coalesce(*[F.try_element_at(_runs(all_, n, equal), F.lit(1)) for n in range(MOST_GRAM, LEAST_GRAM - 1, -1)])))
    own = own.withColumn("_last", F.when(sought & F.col("_first").isNull() & shared, F.coalesce(*[F.try_element_at(_runs(all_, n, shares), F.lit(-1)) for n in range(LEAST_GRAM, MOST_GRAM + 1)])))
    first, last, box = F.col("_first"), F.col("_last"), F.col("_box")
    match = (
        F.when(F.length("_said") < LEAST_CHARS, _match(F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>"), "reject_short_answer", F.lit(None), F.lit(None), F.lit(None)))
        .when(box.isNotNull(), _match(box, "exact_token", F.lit(1.0), F.array_position(norms, said) - 1, F.lit(1)))
        .when(first.isNotNull(), _match(first["rect"], "exact_phrase", F.lit(1.0), first["at"] - 1, first["n"]))
        .when(last.isNotNull(), _match(last["rect"], "numeric_phrase", F.lit(1.0), last["at"] - 1, last["n"]))
    )
    return own.withColumn("match", match).drop("_box", "_hits", "_first", "_last")


def _boxed(rects: Column) -> Column:
    """A 1 for each valid rectangle, a 0 for any other; null if all are, and a 0 without any, as no lines are one that is empty."""
    return F.when(F.size(rects) == 0, "0").when(~F.forall(rects, valid), F.array_join(F.transform(rects, lambda r: F.when(valid(r), "1").otherwise("0")), ""))


_ALIKE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType())])


_ALIKE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType())])
_BEST = T.StructType([*_ALIKE.fields, T.StructField("n", T.IntegerType()), T.StructField("near", T.ArrayType(_ALIKE))])


@F.arrow_udf(_BEST)
def _most_alike(said: pa.Array, lines: pa.Array, boxed: pa.Array, words: pa.Array) -> pa.Array:
    """The phrase most like the answer, the first of equals (N15, N16), null without any; where its score is too low, ``near`` has the token most like each of the words.

    Its score has no bonus for a shared number: the tier before takes every answer that shares one with a phrase in a box. Rows without an answer come with their lines too,
    which aren't looked at: rows wait until Python has read them, and few wait at once only if each gives it something to read.
    """
    asked, own, boxes = said.to_pylist(), words.to_pylist(), boxed.to_pylist()
    some = [i for i, s in enumerate(asked) if s is not None]
    texts: list[str | None] = [None] * len(asked)
    for i, text in zip(some, lines.take(pa.array(some, pa.int64())).to_pylist(), strict=True):
        texts[i] = text
    score, at, n = most_alike(asked, texts, boxes, LEAST_GRAM, MOST_GRAM, COMMON_WEIGHT)
    low = [i for i in some if own[i] and texts[i] is not None and not (n[i] and score[i] >= LEAST_SCORE)]
    near: list[list[dict | None] | None] = [None] * len(asked)
    for i, found in zip(low, words_alike([own[i] for i in low], [texts[i] for i in low], [boxes[i] for i in low]), strict=True):
        near[i] = found
    alike = pa.list_(pa.struct([("score", pa.float64()), ("at", pa.int32())]))
    columns = [pa.array(score, pa.float64(), mask=n == 0), pa.array(at, pa.int32(), mask=n == 0), pa.array(n, pa.int32(), mask=n == 0), pa.array(near, alike)]
    return pa.StructArray.from_arrays(columns, _BEST.names)


def keyword_rects(tokens: Column, words: Column, least: float) -> Column:
    """Boxes of normalised tokens that keywords name, as a struct: ``rects`` are the distinct boxes of tokens that equal a keyword or share a number of two
    digits or more, and of the token most like each keyword that no token equals, from ``least`` on; ``best`` is the most alike of the latter, whatever its likeness.
    """
    # What a lambda names is computed anew for each element, so all of these come as its variables.
    boxed = F.filter(tokens, lambda t: valid(t["rect"]))
    return let(F.struct(words.alias("words"), _numbers_of(words).alias("numbers"), boxed.alias("boxed"), F.transform(tokens, lambda t: t["norm"]).alias("have")), lambda x: _named(x, least))


def _numbers_of(words: Column) -> Column:
    """The numbers of two digits or more in keywords."""
    return F.flatten(F.transform(words, lambda w: F.filter(numbers_in(w), lambda n: F.length(F.replace(n, F.lit("."), F.lit(""))) >= LEAST_DIGITS)))


def _named(x: Column, least: float) -> Column:
    """``keyword_rects`` of a struct of the keywords, their numbers, the tokens with boxes and all tokens' normal forms."""
    equal = F.filter(x["boxed"], lambda t: F.array_contains(x["words"], t["norm"]) | F.arrays_overlap(t["numbers"], x["numbers"]))
    alike = lambda w: F.array_max(F.transform(x["boxed"], lambda t, i: F.struct(token_similarity(w, t["norm"]).alias("score"), (-i).alias("i"), t["rect"].alias("rect"))))
    near = F.transform(F.filter(x["words"], lambda w: ~F.array_contains(x["have"], w)), lambda w, k: F.struct(alike(w).alias("a"), (-k).alias("k")))
    return _chosen(F.transform(equal, lambda t: t["rect"]), F.filter(near, lambda x: x["a"].isNotNull()), least)


def _chosen(equal: Column, near: Column, least: float) -> Column:
    """``rects`` and ``best`` of the boxes of tokens that equal a keyword, and of structs ``a`` (score, rect) and ``k`` (minus the keyword's place) of those most like the others."""

    def told(found: Column) -> Column:
        close = F.filter(found, lambda x: x["a"]["score"] >= least)
        best = F.array_max(F.transform(found, lambda x: F.struct(x["a"]["score"].alias("score"), x["k"].alias("k"), x["a"]["rect"].alias("rect"))))
        return F.struct(F.array_distinct(F.concat(equal, F.transform(close, lambda x: x["a"]["rect"]))).alias("rects"), best.alias("best"))

    return let(near, told)


def _named_by(words: Column, near: Column, norms: Column, forms: Column, rects: Column, least: float) -> Column:
    """``keyword_rects`` where the token most like each keyword is known: ``near``, an array of (score, at), null for keywords that a token equals."""

    def told(x: Column) -> Column:
        # Few keywords equal a token or hold a number; only for those the tokens are gone through.
        numbered = F.size(x["numbers"]) > 0
        same = lambda i: F.array_contains(x["words"], F.get(x["norms"], i)) | (numbered & F.arrays_overlap(numbers_in(F.get(x["forms"], i)), x["numbers"]))
        equal = F.filter(F.transform(x["rects"], lambda r, i: F.when(valid(r) & same(i), r)), lambda r: r.isNotNull())
        close = F.transform(x["near"], lambda a, k: F.when(a.isNotNull(), F.struct(F.struct(a["score"].alias("score"), F.get(x["rects"], a["at"]).alias("rect")).alias("a"), (-k).alias("k"))))
        return _chosen(F.when(F.arrays_overlap(x["words"], x["norms"]) | numbered, equal).otherwise(F.array().cast(_RECTS)), F.filter(close, lambda a: a.isNotNull()), least)

    near = F.coalesce(near, F.array().cast("array<struct<score:double,at:int>>"))  # there are none without keywords
    return let(F.struct(words.alias("words"), _numbers_of(words).alias("numbers"), near.alias("near"), norms.alias("norms"), forms.alias("forms"), rects.alias("rects")), told)


def support_rects(tokens: Column, question: Column, least: float = LEAST_SUPPORT) -> Column:
    """The distinct boxes of normalised tokens that the first ``MOST_KEYWORDS`` keywords of a question name."""
    return keyword_rects(tokens, F.slice(keywords(question, LEAST_KEYWORD), 1, MOST_KEYWORDS), least)["rects"]


def grounded(df: DataFrame, answer: str = "answer", tokens: str = "tokens", question: str | None = None) -> DataFrame:
    """``df`` without its tokens, with ``match`` (rect, why, score, at, n) by the whole cascade (M05): the tiers above; a phrase like the answer; its keywords one by one; for yes and no
    what the question names; the most similar phrase or token whatever its score; the largest box; none."""
    df = df.withColumn("_question", nfkc(F.col(question)) if question else F.lit(None).cast("string"))
    # Rows wait for Python with all that they carry, so what the lines give again goes.
    own, rects = _told(df, answer, tokens).drop("_norms"), F.col(tokens)["rect"]
    unmatched = F.col("match").isNull()
    asked = F.slice(keywords(F.col("_question"), LEAST_KEYWORD), 1, MOST_KEYWORDS) if question else F.array().cast("array<string>")
    own = own.withColumns({"_words": F.when(unmatched, keywords(F.col("_answer"), LEAST_CHARS)), "_asked": F.when(unmatched & F.col("_said").isin(YES_NO), asked)})
    words, asked = F.col("_words"), F.col("_asked")
    both = F.concat(words, F.coalesce(asked, F.array().cast("array<string>")))
    own = own.withColumn("_best", _most_alike(F.when(unmatched, F.col("_said")), F.col("_lines"), F.when(unmatched, _boxed(rects)), both))
    best = F.col("_best")
    similar = lambda why: _match(_run(F.col(tokens), best["at"] + 1, best["n"]), why, best["score"], best["at"], best["n"])
    own = own.withColumn("match", F.coalesce("match", F.when(best["score"] >= LEAST_SCORE, similar("fuzzy_phrase"))))
    sought = F.col("match").isNull()
    norms, forms = F.slice(F.split("_lines", "\n"), 1, F.size(tokens)), F.split("_forms", "\n")
    named = lambda words, near, least: F.when(sought & words.isNotNull(), _named_by(words, near, norms, forms, rects, least))
    found = {"_found": named(words, F.slice(best["near"], 1, F.size(words)), LEAST_TOKEN), "_asked": named(asked, F.slice(best["near"], F.size(words) + 1, F.size(asked)), LEAST_SUPPORT)["rects"]}
    own = own.withColumns(found)
    by_word, by_question, token = union_box(F.col("_found")["rects"]), union_box(F.col("_asked")), F.col("_found")["best"]
    largest = largest_rect(rects)
    none = F.lit(None).cast("int")
    match = (
        F.when(F.col("match").isNotNull(), F.col("match"))
        .when(by_word.isNotNull(), _match(by_word, "per_word_collect", F.lit(1.0), none, none))
        .when(by_question.isNotNull(), _match(by_question, "question_fallback", F.lit(1.0), none, none))
        .when(token.isNotNull() & (best["n"].isNull() | (token["score"] > best["score"])), _match(token["rect"], "forced_best_token_fuzzy_best", token["score"], none, none))
        .when(best["n"].isNotNull(), similar("forced_best_fuzzy_phrase_best"))
        .when(largest.isNotNull(), _match(largest, "largest_box_fallback", F.lit(0.0), none, none))
    )
    return own.withColumn("match", match).drop(tokens, "_answer", "_question", "_said", "_numbers", "_forms", "_lines", "_words", "_best", "_found", "_asked")
