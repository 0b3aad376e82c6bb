"""Scores of single responses and their means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.textnorm import consensus_norm


def matches(answers: Column, prediction: Column) -> Column:
    """How many answers equal the prediction in normal form."""
    said = consensus_norm(prediction)
    return F.size(F.filter(F.transform(answers, consensus_norm), lambda a: a == said))


def counted_matches(kinds: Column, prediction: Column) -> Column:
    """The same for an array of (a, n), where n of the answers are a."""
    said = consensus_norm(prediction)
    return F.aggregate(F.filter(kinds, lambda k: consensus_norm(k["a"]) == said), F.lit(0).cast("long"), lambda m, k: m + k["n"])


def soft_score(n: Column, m: Column) -> Column:
    """The consensus score of a prediction that m of n answers equal: the mean, over each answer left out, of min(1, equal others / 3).

    Closed form; one answer alone always scores 0, no answer is null.
    """
    m = m.cast("double")
    return F.when(n > 0, (m * F.least(F.lit(1.0), (m - 1) / 3) + (n - m) * F.least(F.lit(1.0), m / 3)) / n)


def soft_accuracy(answers: Column, prediction: Column) -> Column:
    return soft_score(F.size(answers), matches(answers, prediction))


def exact_match(answers: Column, prediction: Column) -> Column:
    """1 if any answer equals the prediction in normal form, else 0."""
    return F.coalesce((matches(answers, prediction) > 0).cast("double"), F.lit(0.0))


def response_score(answers: Column, prediction: Column, by_exact_match: Column) -> Column:
    """The score by the metric that a sample asks for."""
    return F.when(by_exact_match, exact_match(answers, prediction)).otherwise(soft_accuracy(answers, prediction))


def answer_list(answers: Column, answer: Column) -> Column:
    """The answers without nulls, else the one answer, else none."""
    return F.coalesce(F.filter(answers, lambda a: a.isNotNull()), F.when(answer.isNotNull(), F.array(answer)), F.array().cast("array<string>"))


def rate(flag: Column, among: Column | None = None) -> Column:
    """The share of true flags, 0 without rows; with ``among`` of the rows where that holds, null without such."""
    value = flag.cast("double")
    return F.coalesce(F.avg(value), F.lit(0.0)) if among is None else F.avg(F.when(among, value))


def percent(score: Column) -> Column:
    """100 times the mean score."""
    return F.coalesce(100 * F.sum(score) / F.count(F.lit(1)), F.lit(0.0))


def failure_rate(correct: Column) -> Column:
    """(total - correct) / total; null without rows."""
    return F.try_divide(F.count(F.lit(1)) - F.sum(correct.cast("long")), F.count(F.lit(1)))


def all_correct(judged: Column) -> Column:
    """Whether no judgement is false; those not judged don't count."""
    return F.coalesce(F.bool_and(judged), F.lit(True))
