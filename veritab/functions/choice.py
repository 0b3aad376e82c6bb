"""Which choice a free-form response names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.textnorm import choice_norm, trimmed

#: Patterns of a response's letter, strong ones first.
LETTER_PATTERNS = [
    r"(?:answer|assistant)\s*:\s*\(?([a-z])\)?",
    r"(?:the\s+answer\s+is|choose)\s*\(?([a-z])\)?",
    r"\(([a-z])\)",
    r"\b([a-z])\)",
    r"\b([a-z])\.",
    r"\[([a-z])\]",
]


def letter_index(x: Column) -> Column:
    """0 for A or a to 25 for Z or z; null for all else."""
    one = F.upper(trimmed(x))
    return F.when(one.rlike("^[A-Z]$"), F.ascii(one) - 65)


def letter_in(response: Column, n_choices: Column | int, most: int = 26) -> Column:
    """The first pattern whose first match is a letter in range, then the first letter from A on that stands alone.

    A bare "a" counts, article or not, and so does the first letter of a word after "answer:"; both belong to the metric.
    """
    n = F.lit(n_choices) if isinstance(n_choices, int) else n_choices
    found = []
    for p in LETTER_PATTERNS:
        i = letter_index(F.regexp_extract(response, f"(?i){p}", 1))
        found.append(F.when(i < n, i))
    bare = [F.when((F.lit(i) < n) & response.rlike(rf"(?i)\b{chr(65 + i)}\b"), F.lit(i)) for i in range(min(most, n_choices) if isinstance(n_choices, int) else most)]
    return F.coalesce(*found, *bare)


def choice_by_text(response: Column, choices: Column) -> Column:
    """The choice whose normal form is part of the response's or the other way round: the longest, of those the last."""
    said = choice_norm(response)
    forms = F.transform(choices, lambda c, i: F.struct(F.length(choice_norm(c)).alias("n"), i.alias("i"), choice_norm(c).alias("c")))
    fits = F.filter(forms, lambda f: (f["n"] > 0) & (said != "") & (F.contains(said, f["c"]) | F.contains(f["c"], said)))
    return F.array_max(F.transform(fits, lambda f: F.struct(f["n"], f["i"])))["i"]


def predicted_choice(response: Column, choices: Column, n_choices: int | None = None) -> Column:
    """The index of the choice that a response names, by letter or else by text; null where it names none."""
    return F.coalesce(letter_in(response, n_choices if n_choices is not None else F.size(choices)), choice_by_text(response, choices))


def answer_index(answer: Column, choices: Column) -> Column:
    """An answer given as an index, a letter or a choice's text, as an index."""
    number = answer.try_cast("int")
    same = F.array_position(F.transform(choices, choice_norm), choice_norm(answer)) - 1
    return F.coalesce(F.when((number >= 0) & (number < F.size(choices)), number), F.when(letter_index(answer) < F.size(choices), letter_index(answer)), F.when(same >= 0, same.cast("int")))


def letter_of(index: Column) -> Column:
    """A for 0, B for 1 and so on."""
    return F.chr(index + 65)
