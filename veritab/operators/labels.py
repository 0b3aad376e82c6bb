"""Choosing labels by score: best, filtered, and the true label of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.hierarchy import ancestry, pseudo_leaves

#: The score from which a label counts, and the depth that is preferred.
LEAST_SCORE, LEAST_DEPTH = 0.2, 3


def best_label(scores: DataFrame, key: str) -> DataFrame:
    """(key, label, score): the best of each key, the first by name among equals; null scores don't count (A01). One partial aggregate, no window."""
    best = F.min(F.struct((-F.col("score")).alias("far"), "label"))
    return scores.where("score IS NOT NULL").groupBy(key).agg(best.alias("b")).select(key, F.col("b.label").alias("label"), (-F.col("b.far")).alias("score"))


def above_or_best(scores: Column, least: float = LEAST_SCORE) -> Column:
    """Of an array of (label, score): those with at least the score, or else the best, the first of equals; nulls go."""
    known = F.filter(scores, lambda s: s["score"].isNotNull())
    good = F.filter(known, lambda s: s["score"] >= least)
    best = F.slice(F.filter(known, lambda s: s["score"] == F.array_max(F.transform(known, lambda t: t["score"]))), 1, 1)
    return F.when(F.size(good) > 0, good).otherwise(best)


def above_and_best(scores: DataFrame, key: str, least: float = LEAST_SCORE) -> DataFrame:
    """(key, labels): the labels with at least the score, and the best in any case, by name."""
    best = F.min(F.struct((-F.col("score")).alias("far"), "label"))["label"]
    good = F.collect_set(F.when(F.col("score") >= least, F.col("label")))
    return scores.where("score IS NOT NULL").groupBy(key).agg(F.array_sort(F.array_union(good, F.array(best))).alias("labels"))


def sorted_scores(scores: Column) -> Column:
    """A map of scores as an array of (label, score), the highest first, by name among equals."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("far"), e["key"].alias("label"))))
    return F.transform(ranked, lambda r: F.struct(r["label"], (-r["far"]).alias("score")))


def true_label(scores: DataFrame, truth: DataFrame, closed: DataFrame, key: str, root: str | None = "Entity", least_depth: int = LEAST_DEPTH, compat: bool = False) -> DataFrame:
    """(key, y_true, score, reason) for each key of ``scores``.

    ``truth`` (key, label) is cut to what lies under the root and pruned to its leaves; its best-scored label counts, deep ones before
    shallow. Without one, the best of all scores does, labels under the root first. Rows with a null key and null labels don't count.
    ``compat``: the truth never matches, as where one side's keys are text (Q1), and the two fallback reasons change places (Q2).
    """
    known = ancestry(closed, root)
    marked = known.marked(truth.select(key, "label"))
    leaves = known.marked(pseudo_leaves(marked if root is None else marked.where("rooted"), closed, key, known=known))
    if compat:
        leaves, truth = leaves.limit(0), truth.limit(0)
    tier = F.when(F.col("node_depth") >= least_depth, 1).otherwise(2)
    inside = F.lit(True) if root is None else F.col("rooted")
    none = F.lit(None).cast("struct<label:string,score:double,inside:boolean>")
    rows = known.marked(scores.select(key, "label", "score")).select(key, F.struct("label", F.col("score").cast("double").alias("score"), inside.alias("inside")).alias("scored"), F.lit(None).cast("struct<label:string,tier:int>").alias("leaf"), F.lit(False).alias("has_truth"))
    rows = rows.unionByName(leaves.select(key, none.alias("scored"), F.struct("label", tier.alias("tier")).alias("leaf"), F.lit(True).alias("has_truth")))
    rows = rows.unionByName(truth.select(key, none.alias("scored"), F.lit(None).cast("struct<label:string,tier:int>").alias("leaf"), F.lit(True).alias("has_truth")))
    # A key's scores and leaves meet in one row: different labels only.
    sets = rows.groupBy(key).agg(F.collect_set("scored").alias("scored"), F.map_from_entries(F.collect_set("leaf")).alias("leaf"), F.max("has_truth").alias("has_truth")).where("size(scored) > 0")
    ranked = F.transform(F.filter("scored", lambda s: s["score"].isNotNull()), lambda s: F.struct(F.coalesce(F.try_element_at("leaf", s["label"]), F.when(s["inside"], 3).otherwise(4)).alias("tier"), (-s["score"]).alias("far"), s["label"].alias("label")))
    ranked = sets.select(key, F.array_min(ranked).alias("b"), "has_truth")
    empty, other = ("fallback_gt_empty", "fallback_any") if compat else ("fallback_any", "fallback_gt_empty")
    reason = F.when(F.col("b").isNull(), "no_scores").when(F.col("b.tier") == 1, "picked_depth>=3").when(F.col("b.tier") == 2, "picked_depth<=2").when(F.col("has_truth"), empty).otherwise(other)
    return ranked.select(key, F.col("b.label").alias("y_true"), (-F.col("b.far")).alias("score"), reason.alias("reason"))


def open_labels(scores: DataFrame, truth: DataFrame, closed: DataFrame, key: str, root: str = "Entity", instead: str = "Aircraft") -> tuple[DataFrame, DataFrame]:
    """((key, label, score), keys without any): the pruned truth under the root that has a score; a key left empty takes the score of one stand-in label."""
    known = ancestry(closed, root)
    leaves = pseudo_leaves(known.marked(truth.select(key, "label")).where("rooted"), closed, key, known=known)
    none = F.lit(None).cast("struct<label:string,score:double>")
    rows = scores.where("score IS NOT NULL").select(key, F.struct("label", F.col("score").cast("double").alias("score")).alias("scored"), F.lit(None).cast("string").alias("leaf"), F.lit(False).alias("has_truth"))
    rows = rows.unionByName(leaves.select(key, none.alias("scored"), F.col("label").alias("leaf"), F.lit(True).alias("has_truth")))
    rows = rows.unionByName(truth.select(key, none.alias("scored"), F.lit(None).cast("string").alias("leaf"), F.lit(True).alias("has_truth")))
    sets = rows.groupBy(key).agg(F.collect_set("scored").alias("scored"), F.collect_set("leaf").alias("leaf"), F.max("has_truth").alias("has_truth"))
    found = F.filter("scored", lambda s: F.array_contains("leaf", s["label"]))
    other = F.filter("scored", lambda s: s["label"] == instead)
    sets = sets.select(key, F.when(F.size(found) > 0, found).otherwise(other).alias("kept"), "has_truth")
    return sets.select(key, F.inline("kept")), sets.where("has_truth AND size(kept) = 0").select(key)


def majority(answer: Column) -> Column:
    """The most frequent value of a group, the lowest of equals (A07, A08): an aggregate."""
    return F.mode(answer, deterministic=True)


def majority_of(answers: Column, otherwise: str = "unknown") -> Column:
    """The most frequent element of an array, the lowest of equals, a stand-in if empty."""
    kinds = F.transform(F.array_sort(F.array_distinct(answers)), lambda a: F.struct((-F.size(F.filter(answers, lambda b: b == a))).alias("n"), a.alias("a")))
    return F.coalesce(F.array_min(kinds)["a"], F.lit(otherwise))


def majority_counted(kinds: Column, otherwise: str = "unknown") -> Column:
    """The same for an array of (a, n), where n of the answers are a; equal elements count together."""
    total = lambda a: F.aggregate(F.filter(kinds, lambda k: k["a"] == a), F.lit(0).cast("long"), lambda m, k: m + k["n"])
    words = F.array_sort(F.array_distinct(F.transform(kinds, lambda k: k["a"])))
    return F.coalesce(F.array_min(F.transform(words, lambda a: F.struct((-total(a)).alias("n"), a.alias("a"))))["a"], F.lit(otherwise))


def combined(answers: Column, otherwise: str = "unknown") -> Column:
    """The distinct elements of an array by name, with commas (A10)."""
    kept = F.array_sort(F.array_distinct(F.filter(answers, lambda a: a != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.lit(otherwise))


def top_answer(answers: Column, stop: list[str]) -> Column:
    """The most frequent element that is no stop answer, the lowest of equals (A09, F08); null without any."""
    kept = F.filter(answers, lambda a: ~a.isin(stop))
    return F.when(F.size(kept) > 0, majority_of(kept))


def top_counted(kinds: Column, stop: list[str]) -> Column:
    """The same for an array of (a, n), where n of the answers are a."""
    kept = F.filter(kinds, lambda k: ~k["a"].isin(stop))
    return F.when(F.size(kept) > 0, majority_counted(kept))


def highest(scores: Column) -> Column:
    """The answer with the highest score of an array of (answer, score), the first of equals (A11); null scores don't count."""
    known = F.filter(scores, lambda s: s["score"].isNotNull())
    return F.array_max(F.transform(known, lambda s, i: F.struct(s["score"], (-i).alias("i"), s["answer"])))["answer"]
