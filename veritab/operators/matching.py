"""Nearest classes by blocked matrix products, and the match metrics of generated text against a vocabulary of class vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.vectors import dot
from veritab.operators.checkpoints import cut

#: Class tables of so many bytes at most, measured, go to every worker; larger ones meet the rows block by block.
MOST_BYTES = 64 << 20
#: Classes of a block, rows of a group beside it, and rows of one product.
BLOCK, GROUP, ROWS = 8192, 8192, 1024


def finite(v: Column) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, number), F.lit(False))


def nearest(rows: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, class numbers and similarities of the k classes nearest to each row, nearest first, the lower class among equals.

    A product in blocked float64 tells which classes can be among the k, with its rounding bounded; their similarities are summed anew, component by component, so that
    they depend neither on the block nor on the library.
    """
    k, eps = min(k, len(classes)), 4 * (rows.shape[1] + 2) * np.finfo(float).eps
    longest = np.sqrt((classes * classes).sum(axis=1)).max()
    out: list = []
    for at in range(0, len(rows), ROWS):
        own = rows[at : at + ROWS]
        rough = own @ classes.T
        slack = eps * np.sqrt((own * own).sum(axis=1)) * longest
        least = np.partition(rough, len(classes) - k, axis=1)[:, len(classes) - k]
        r, c = np.nonzero(~(rough < (least - 2 * slack)[:, None]))
        sims = np.empty(len(r))
        for i in range(0, len(r), 1 << 15):
            part = slice(i, i + (1 << 15))
            sims[part] = np.cumsum(own[r[part]] * classes[c[part]], axis=1)[:, -1]
        order = np.lexsort((c, -sims, r))
        r, c, sims = r[order], c[order], sims[order]
        first = np.searchsorted(r, r)  # where each row's own begin
        keep = np.arange(len(r)) - first < k
        out.append((r[keep] + at, c[keep], sims[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _tops(vectors: list, tables: dict[int, tuple[list, np.ndarray]], k: int) -> list:
    """For each vector its nearest classes as dicts, from the table of its length; none where there is no such table."""
    out: list = [[] for _ in vectors]
    lengths = np.array([len(v) for v in vectors])
    for d, (labels, matrix) in tables.items():
        places = np.flatnonzero(lengths == d)
        if len(places):
            for r, c, s in zip(*nearest(np.array([vectors[p] for p in places], dtype=float), matrix, k)):
                out[places[r]].append({"far": -float(s), "label": labels[c]})
    return out


def _tables(labels: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Class tables by the length of their vectors, in the order of labels."""
    by: dict[int, list] = {}
    for label, v in sorted(zip(labels, vectors), key=lambda x: x[0]):
        by.setdefault(len(v), []).append((label, v))
    return {d: ([x for x, _ in own], np.array([v for _, v in own], dtype=float)) for d, own in by.items()}


def nearest_classes(df: DataFrame, classes: DataFrame, vector: str, k: int, label: str = "label", class_vector: str = "vector", into: str = "top", block: int | None = None) -> DataFrame:
    """``df`` with its k nearest classes by inner product, (far, label) nearest first, by label among equals; far is the negated similarity.

    A class table that is measured to be small goes to every worker, and rows stay where they are. A larger one (or ``block`` given) is cut into blocks: distinct vectors, dealt by their hash, meet
    each block in groups of bounded size, and of each block only k classes go on to the merge. Labels are unique and not null. Vectors that are null, empty or hold null or non-finite components get null; classes with such vectors are
    left out, and only vectors of equal length meet: a row that meets no class gets an empty array.
    """
    known = classes.select(F.col(label).alias("label"), F.col(class_vector).cast("array<double>").alias("vector")).where(F.col("label").isNotNull() & finite(F.col("vector")))
    known = cut(known)
    kind = known.schema["label"].dataType.simpleString()
    top = f"array<struct<far:double,label:{kind}>>"
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()
    if block is None and size <= MOST_BYTES:
        return _beside(df, known, vector, k, into, top)
    block = block or BLOCK
    blocks = max(1, -(-n // block))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
    asked = df.select(F.col(vector).cast("array<double>").alias("_v")).where(finite(F.col("_v"))).distinct()
    asked = cut(asked)
    groups = max(1, -(-asked.count() // GROUP))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = asked.select("_v", F.pmod(F.xxhash64("_v"), F.lit(groups)).alias("slice"), F.explode(numbers(blocks)).alias("block"))
    right = dealt.select("label", "vector", F.explode(numbers(groups)).alias("slice"), "block")

    def meet(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        tops = _tops(own["_v"].tolist(), _tables(table["label"].tolist(), table["vector"].tolist()), k)
        return pd.DataFrame({"_v": own["_v"], "top": tops})

    parts = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(meet, f"_v array<double>, top {top}")
    merged = parts.groupBy("_v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias(into))
    return df.join(merged, F.col(vector).cast("array<double>") == F.col("_v"), "left").drop("_v")


def _beside(df: DataFrame, known: DataFrame, vector: str, k: int, into: str, top: str) -> DataFrame:
    """The nearest of a small class table, which every worker has."""
    rows = known.collect()  # at most MOST_BYTES
    table = df.sparkSession.sparkContext.broadcast(_tables([r.label for r in rows], [r.vector for r in rows]))

    def run(pdfs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in pdfs:
            yield pd.Series(_tops(own.tolist(), table.value, k), index=own.index, dtype=object)

    found = F.pandas_udf(run, top)
    v = F.col(vector).cast("array<double>")
    # A vector that takes no part goes as an empty one, which no table has.
    return df.withColumn(into, F.when(finite(v), found(F.when(finite(v), v).otherwise(F.array().cast("array<double>")))))


def match_records(df: DataFrame, vocabulary: DataFrame, k: int, truth: str = "truth", word: str = "word", vector: str = "vector", word_vector: str = "word_vector", top: str = "top") -> DataFrame:
    """``df`` (its nearest classes in ``top``) with hit_at_1, hit_at_k, attack_at_1 and attack_at_k.

    A hit is any of the true labels, an array, as the first or among the k. An attack's word that the vocabulary (label) has succeeds likewise; one outside it
    succeeds if its own vector is at least as near as the first or the k-th class (the last, if fewer). No word, no verdict: null. An unknown word without a vector, or a row without classes, fails.
    """
    first, among = F.try_element_at(top, F.lit(1)), F.transform(F.slice(top, 1, k), lambda t: t["label"])
    last = F.try_element_at(F.slice(top, 1, k), F.lit(-1))
    known = vocabulary.select(F.col("label").alias("_word")).where("label IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    own = df.join(known, F.col(word) == F.col("_word"), "left")  # words of a vocabulary: Spark broadcasts them where they are few
    sim = dot(F.col(vector), F.col(word_vector))
    no = lambda c: F.coalesce(c, F.lit(False))
    attack = lambda inside, bar: F.when(F.col(word).isNotNull(), no(F.when(F.col("_known"), inside).otherwise(sim >= -bar["far"])))
    return own.withColumns({
        "hit_at_1": no(F.array_contains(truth, first["label"])),
        "hit_at_k": no(F.arrays_overlap(F.col(truth), among)),
        "attack_at_1": attack(first["label"] == F.col(word), first),
        "attack_at_k": attack(F.array_contains(among, F.col(word)), last),
    }).drop("_word", "_known")


def match_metrics(records: DataFrame) -> DataFrame:
    """Shares of hits over all records (0 of none) and of successful attacks over those with a word (null of none), with both counts."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return records.agg(
        F.coalesce(share("hit_at_1"), F.lit(0.0)).alias("acc_at_1"), F.coalesce(share("hit_at_k"), F.lit(0.0)).alias("acc_at_k"),
        share("attack_at_1").alias("asr_at_1"), share("attack_at_k").alias("asr_at_k"), F.count("*").alias("n"), F.count("attack_at_1").alias("n_attacked"),
    )
