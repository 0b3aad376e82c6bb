"""What generated texts and provider responses hold, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.textnorm import plain_norm, trimmed


def flat_blocks(text: Column) -> Column:
    """All {...} without braces inside (N17, for flat objects)."""
    return F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1)


def balanced(text: str) -> list[str]:
    """The outermost {...} of a text, in order; what never closes is none."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c == "{":
            begin, depth = (i if not depth else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_blocks(text: pd.Series) -> pd.Series:
    """All outermost {...}, with objects inside."""
    return text.map(lambda x: [] if x is None else balanced(x))


def repaired(json: Column) -> Column:
    """Double quotes for single ones, no trailing commas, no spaces around colons and commas."""
    out = F.regexp_replace(F.replace(json, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\s*:\s*", ":"), r"\s*,\s*", ",")


def _field(block: Column, name: str) -> Column:
    found = F.filter(F.map_entries(F.from_json(block, "map<string,string>", {"mode": "PERMISSIVE"})), lambda e: (F.lower(trimmed(e["key"])) == name) & (trimmed(e["value"]) != ""))
    return F.try_element_at(found, F.lit(-1))["value"]


def json_field(text: Column, name: str, nested: bool = False) -> Column:
    """The first non-empty string under a key, whatever its case: of each block as it is, then repaired; else after the key in plain text."""
    blocks = balanced_blocks(text) if nested else flat_blocks(text)
    found = F.filter(F.transform(blocks, lambda b: F.coalesce(_field(b, name), _field(repaired(b), name))), lambda v: v.isNotNull())
    low = F.lower(text)
    hinted = F.startswith(low, F.lit(f"{name}:")) | F.contains(low, F.lit(f'"{name}":')) | F.contains(low, F.lit(f"'{name}':"))
    plain = F.nullif(F.regexp_extract(text, rf"(?i){name}\s*[:=]\s*['\"]?([\w\s]{{1,30}})['\"]?", 1), F.lit(""))
    return plain_norm(F.coalesce(F.try_element_at(found, F.lit(1)), F.when(hinted, plain)))


def overlaps(candidate: Column, answers: Column) -> Column:
    """Whether a candidate is blank or equals an answer."""
    return F.coalesce(candidate, F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(F.array_contains(answers, candidate), F.lit(False))


def word_validity(candidate: Column, answers: Column) -> Column:
    """``json_parse_failed``, ``answer_overlap`` or ``ok``."""
    return F.when(candidate.isNull(), "json_parse_failed").when(overlaps(candidate, answers), "answer_overlap").otherwise("ok")


def judged(answer: Column, correct: Column, question: Column, dataset: Column, score: Column | None = None) -> Column:
    """Whether an answer is right, as its dataset judges (N21); null for datasets without a rule.

    ``typo_base``: the option's letter, alone or in brackets, or its text, which stands in the question between "(a) " and " (b) ";
    ``vqav2``: the right answer is in it; ``LingoQA``: a classifier's score is over a half.
    """
    options = F.split(F.element_at(F.split(question, r"\(a\) "), 2), r" \(b\) ")
    a, b = F.lower(options[0]), F.lower(F.regexp_replace(options[1], r"[ (c)]+$", ""))
    named = lambda letter, text: (answer == letter) | F.contains(answer, F.lit(f"{letter})")) | F.contains(answer, text)
    choice = F.when(correct == "a", named("a", a)).when(correct == "b", named("b", b)).otherwise(False)
    out = F.when(F.contains(dataset, F.lit("typo_base")), choice).when(F.contains(dataset, F.lit("vqav2")), F.contains(F.lower(answer), F.lower(correct)))
    return out if score is None else out.when(dataset == "LingoQA", score > 0.5)


def response_text(whole: Column, parts: Column) -> Column:
    """A provider's text if it has one, else its non-empty parts on lines of their own (P18). ``parts``: array of arrays of strings."""
    chunks = F.filter(F.flatten(F.filter(parts, lambda p: p.isNotNull())), lambda c: c.isNotNull() & (c != ""))
    return trimmed(F.coalesce(F.nullif(whole, F.lit("")), F.array_join(chunks, "\n"), F.lit("")))


def last_turn(responses: Column) -> Column:
    """The last of an array of responses; empty without any."""
    return F.coalesce(F.try_element_at(responses, F.lit(-1)), F.lit(""))


def score_map(pairs: Column) -> Column:
    """An array of (answer, score) as a map, the last of equal answers winning; null answers go."""
    known = F.filter(pairs, lambda p: p["answer"].isNotNull())
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.greatest(F.size(known), F.lit(1))), lambda q: q["answer"] == p["answer"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["answer"], p["score"])))


def json_safe(value: Column) -> Column:
    """Any nested value as JSON text (P17): structs and maps as objects, arrays as lists, null as null, times and binary as strings."""
    return F.get_json_object(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), "$.v")


def structured(text: Column, schema: str) -> Column:
    """A response parsed by a schema (X09), as a struct of ``value`` and ``reason``: a field that is missing, or of another type, makes it invalid, as does text that is no JSON object."""
    fields = T._parse_datatype_string(schema).fields
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    missing = F.filter(F.array(*[F.when(value[f.name].isNull(), F.lit(f.name)) for f in fields]), lambda n: n.isNotNull())
    whole = F.get_json_object(text, "$")  # null unless the text is JSON
    good = whole.isNotNull() & F.startswith(F.ltrim(text), F.lit("{"))
    return F.struct(F.when(good & (F.size(missing) == 0), value).alias("value"), F.when(~F.coalesce(good, F.lit(False)), "no_json").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).otherwise("ok").alias("reason"))
