"""First rows, samples, shuffles and distractors, the same at every run: order comes from md5 of a seed and a key, never from a generator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.textnorm import hash_unit
from veritab.operators.checkpoints import cut


def rank_hash(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *keys))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key (T03, T04): a partial aggregate, so a frequent key is no burden."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, "_r.*")


def sampled(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in the order of their hashes, all rows for n below 1 (T05). Only the best n of each partition are exchanged."""
    return df if n <= 0 else df.orderBy(rank_hash(seed, *map(F.col, keys)), *keys).limit(n)


def disjoint_samples(tables: list[tuple[DataFrame, int]], seed: int, key: str) -> list[DataFrame]:
    """A sample of each table, without a key that an earlier sample has."""
    taken, out = [], []
    for df, n in tables:
        free = reduce(lambda d, t: d.join(t, key, "left_anti"), taken, df)
        out.append(sampled(free, n, seed, key))
        taken.append(out[-1].select(key))
    return out


def overlapping_samples(tables: list[tuple[DataFrame, int]], seed: int, key: str) -> list[DataFrame]:
    """A sample of each table by the same seed."""
    return [sampled(df, n, seed, key) for df, n in tables]


def shuffled(items: Column, seed: int, *keys: Column) -> Column:
    """An array in the order of its elements' hashes."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(rank_hash(seed, *keys, x).alias("h"), x.alias("x"))))
    return F.transform(ranked, lambda r: r["x"])


def picked(items: Column, seed: int, *keys: Column) -> Column:
    """The element with the least hash, null of none."""
    return F.array_min(F.transform(items, lambda x: F.struct(rank_hash(seed, *keys, x).alias("h"), x.alias("x"))))["x"]


def tertile_cuts(values: Column) -> Column:
    """(low, first, second, high) of an array: the elements at the shares 0, 1/3, 2/3 and 1 of its order, halves to even."""
    ordered = F.array_sort(values)
    at = lambda p: F.element_at(ordered, (F.rint(F.lit(p) * (F.size(ordered) - 1)) + 1).cast("int"))
    return F.when(F.size(ordered) > 0, F.struct(at(0.0).alias("low"), at(1 / 3).alias("first"), at(2 / 3).alias("second"), at(1.0).alias("high")))


def bucket_members(values: Column, cuts: Column, bucket: str) -> Column:
    """The elements (structs with ``value``) of a distance bucket, both ends included."""
    low, high = {"near": ("low", "first"), "mid": ("first", "second"), "far": ("second", "high")}[bucket]
    return F.filter(values, lambda v: (v["value"] >= cuts[low]) & (v["value"] <= cuts[high]))


#: Where to look when a bucket is empty.
BUCKET_ORDER = {"far": ["far", "mid", "near"], "mid": ["mid", "far", "near"], "near": ["near", "mid", "far"]}


def from_bucket(values: Column, cuts: Column, bucket: str) -> Column:
    """The members of the first bucket in its order of preference that has any, else all."""
    out = values
    for name in reversed(BUCKET_ORDER[bucket]):
        own = bucket_members(values, cuts, name)
        out = F.when(F.size(own) > 0, own).otherwise(out)
    return out


def weighted(choices: list[tuple[str, float]], *keys: Column) -> Column:
    """A choice by its weight, from the hash of the keys."""
    total, so_far, unit, out = sum(w for _, w in choices), 0.0, hash_unit(*keys), F.lit(choices[-1][0])
    cuts = []
    for name, w in choices:
        so_far += w / total
        cuts.append((so_far, name))
    for c, name in reversed(cuts[:-1]):
        out = F.when(unit < c, F.lit(name)).otherwise(out)
    return out


def distractor_pools(vocabulary: DataFrame, closed: DataFrame, descendants: DataFrame, root: str = "Entity") -> DataFrame:
    """For each label as the true one, its pools of labels under the root: (y_true, hard, medium, easy, base).

    With L its deepest ancestor's depth (2 at least), hard ones share an ancestor at L, medium ones at L - 1 but not L, easy
    ones at L - 2 but neither; depths below 2 count as 2. The pools depend on the label alone, so there are as many rows as labels.
    """
    rooted = closed.where((F.col("depth") == 1) & (F.col("ancestor") == root)).select("label").distinct()
    level = closed.where("depth > 1").groupBy("label").agg(F.max("depth").alias("top"))
    known = vocabulary.select(F.col("label").alias("y_true")).distinct().join(level.withColumnRenamed("label", "y_true"), "y_true", "left").withColumn("top", F.coalesce("top", F.lit(2)))
    others = vocabulary.select("label").distinct().join(rooted, "label", "left_semi")
    mine = closed.select(F.col("label").alias("y_true"), "depth", "ancestor")
    shared = mine.join(closed.select("label", "depth", "ancestor"), ["depth", "ancestor"]).where("label <> y_true").select("y_true", "depth", "label").distinct()
    levels = known.withColumns({"lm": F.greatest(F.lit(2), F.col("top") - 1), "le": F.greatest(F.lit(2), F.col("top") - 2)})
    flags = levels.join(shared, "y_true").groupBy("y_true", "label").agg(*[F.max((F.col("depth") == F.col(c)).cast("int")).alias(n) for c, n in (("top", "at_l"), ("lm", "at_m"), ("le", "at_e"))])
    kin = closed.select(F.col("label").alias("y_true"), F.col("ancestor").alias("label")).union(descendants.select(F.col("label").alias("y_true"), F.col("descendant").alias("label"))).distinct()
    pairs = levels.select("y_true").join(others, F.col("label") != F.col("y_true")).join(kin, ["y_true", "label"], "left_anti").join(flags, ["y_true", "label"], "left").na.fill(0)
    pool = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("label"))))
    hard, medium, easy = F.col("at_l") == 1, (F.col("at_m") == 1) & (F.col("at_l") == 0), (F.col("at_e") == 1) & (F.col("at_m") == 0) & (F.col("at_l") == 0)
    return known.select("y_true").join(pairs.groupBy("y_true").agg(pool(hard).alias("hard"), pool(medium).alias("medium"), pool(easy).alias("easy"), pool(F.lit(True)).alias("base")), "y_true", "left")


#: Pools of so many labels altogether, at most, are broadcast.
MOST_BROADCAST = 2_000_000


def distractors(questions: DataFrame, pools: DataFrame, key: str, seed: int = 42, excluded: str | None = None) -> DataFrame:
    """``questions`` (key, y_true, and perhaps an array of labels to exclude) with hard, medium and easy: distinct labels, each from the first of its pools that still has one.

    Hard falls back to medium, medium to easy, and all to any label left. Pools come as arrays by a join on the true label, which is broadcast only where it is measured to be small; no
    row a candidate. A question's candidates are hashed and ordered once; each pick is the first of its pool in that order.
    """
    flag = lambda pool: lambda x: F.coalesce(F.array_contains(pool, x), F.lit(False))
    flagged = F.transform("base", lambda x: F.struct(x.alias("x"), *[flag(p)(x).alias(p) for p in ("hard", "medium", "easy")]))
    candidates = pools.select(F.col("y_true").alias("_y"), flagged.alias("_base"))
    candidates = cut(candidates)
    small = (candidates.agg(F.sum(F.size("_base"))).first()[0] or 0) <= MOST_BROADCAST
    joined = questions.join(F.broadcast(candidates) if small else candidates, F.col("y_true") == F.col("_y"), "left").drop("_y")
    allowed = F.filter("_base", lambda b: ~F.coalesce(F.array_contains(excluded, b["x"]), F.lit(False))) if excluded else F.col("_base")
    ranked = F.array_sort(F.transform(allowed, lambda b: F.struct(rank_hash(seed, F.col(key), b["x"]).alias("h"), *[b[f].alias(f) for f in ("x", "hard", "medium", "easy")])))
    out = joined.withColumn("_ranked", ranked)
    first = lambda test: F.try_element_at(F.filter("_ranked", test), F.lit(1))["x"]
    taken: list[str] = []
    for name, order in (("hard", ["hard", "medium"]), ("medium", ["medium", "easy"]), ("easy", ["easy"])):
        free = lambda b, own=tuple(taken): reduce(lambda ok, t: ok & ~b["x"].eqNullSafe(F.col(t)), own, F.lit(True))
        tries = [first(_both(p, free)) for p in order]
        out = out.withColumn(name, F.coalesce(*tries, first(_both(None, free)), F.col("y_true")))
        taken.append(name)
    return out.drop("_base", "_ranked")


def _both(pool: str | None, free):
    """A test of a candidate: in a pool, or in any, and free."""
    return lambda b: (b[pool] & free(b)) if pool else free(b)
