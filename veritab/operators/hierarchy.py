"""Class hierarchies as tables of edges and of absolute-depth ancestors.

The closure has rows (label, depth, ancestor): on some path from a root, which has depth 1, ``ancestor`` stands at ``depth``
above ``label``. Roots have no rows. Closures come by doubling: a round joins all pairs found with those exactly 2**k steps
apart, so a hierarchy of depth d takes about log2(d) rounds. Labels of a cycle count as one place: they are each other's
ancestors, at the depths of the cycle, and steps within it don't deepen. A label that no root reaches has no rows.

Whether a label is an ancestor of another in its set is a bit: each label that has something below it gets a number, and every label
the bitmap of its ancestors' numbers, packed in longs. A set is then pruned within its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators.checkpoints import cut

NODES = "node_id string, parent_id string, name string, path array<string>"


def nodes_of(spark: SparkSession, trees: DataFrame | str) -> DataFrame:
    """The nodes of nested JSON {name, children} (S04, H01), with the names from the root down to each: a row ``value`` is one tree or a list of them.

    Each round takes one level of all trees apart, so a tree is never whole but in its own row. A node without a name as text is left out with what is below it; so is a
    row that is no JSON. A node's id is its row's and the places of the nodes above it.
    """
    if isinstance(trees, str):
        trees = spark.createDataFrame([(trees,)], "value string")
    top = trees.select(F.try_parse_json("value").alias("v"), F.monotonically_increasing_id().cast("string").alias("_tree"))
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    level = top.where("v IS NOT NULL").select(F.posexplode(listed).alias("_i", "v"), F.col("_tree").alias("parent_id"), F.array().cast("array<string>").alias("path"))
    every, first = None, True
    while True:
        named = F.schema_of_variant("v").startswith("OBJECT") & F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.name", "variant")) == "STRING", F.lit(False))
        level = level.where(named).select(
            F.concat_ws(".", "parent_id", "_i").alias("node_id"), F.lit(None).cast("string").alias("parent_id") if first else F.col("parent_id"), F.try_variant_get("v", "$.name", "string").alias("name"),
            F.concat("path", F.array(F.try_variant_get("v", "$.name", "string"))).alias("path"), F.try_variant_get("v", "$.children", "array<variant>").alias("_below"),
        )
        level = cut(level)
        found = level.drop("_below")
        every, first = (found if every is None else every.unionByName(found)), False
        level = level.where("size(_below) > 0").select(F.posexplode("_below").alias("_i", "v"), F.col("node_id").alias("parent_id"), "path")
        if level.isEmpty():
            return every


def edges_of(nodes: DataFrame) -> DataFrame:
    """Distinct (parent, child) names of a node table."""
    up = nodes.select(F.col("node_id").alias("_id"), F.col("name").alias("parent"))
    return nodes.join(up, F.col("parent_id") == F.col("_id")).select("parent", F.col("name").alias("child")).distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """The closure along tree paths, merged by name only at the end: a name in two places has the ancestors of both (H01). The paths hold it; no join is needed."""
    return nodes.select(F.col("name").alias("label"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("_i", "ancestor")).select("label", (F.col("_i") + 1).alias("depth"), "ancestor").distinct()


#: Graphs of up to so many edges are one partition, whose rounds need no exchange.
FEW_EDGES = 20_000


def _doubled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], bool]:
    """All pairs (u, v) with a walk from u to v, for each k up to the last round those (u, v) with a walk of exactly 2**k steps, and whether there are cycles."""
    pairs = cut(edges.select(F.col("parent").alias("u"), F.col("child").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct().withColumn("exact", F.lit(True)))
    steps, many = [], None
    while True:
        found = pairs.agg(F.count("*").alias("n"), F.count_if("exact").alias("e"), F.count_if(F.col("u") == F.col("v")).alias("c")).first()
        if many is None and found.n <= FEW_EDGES:
            pairs = pairs.coalesce(1)
        step = pairs.where("exact").select("u", "v")
        if found.e:
            steps.append(step)
        # Without a new pair from up to 2**k to up to 2**(k+1) steps there is none beyond: a nearest pair that far would have one in between.
        if not found.e or found.n == many:
            return pairs.select("u", "v"), steps, found.c > 0
        many = found.n
        on = step.select(F.col("u").alias("w"), F.col("v").alias("_v"))
        longer = pairs.join(on, F.col("v") == F.col("w")).select("u", F.col("_v").alias("v"), "exact")
        both = pairs.select("u", "v", F.lit(False).alias("exact")).unionByName(longer)
        pairs = cut((both.coalesce(1) if pairs.rdd.getNumPartitions() == 1 else both).groupBy("u", "v").agg(F.max("exact").alias("exact")))


def _depths(tops: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(label, depth): all lengths of walks from the tops, which have depth 1, by the binary digits of the length."""
    found = tops.select("label", F.lit(1).alias("depth"))
    for k, step in enumerate(steps):
        deeper = found.join(step, F.col("label") == F.col("u")).select(F.col("v").alias("label"), (F.col("depth") + (1 << k)).alias("depth"))
        found = found.unionByName(deeper)
        found = (found.coalesce(1) if step.rdd.getNumPartitions() == 1 else found).distinct()
        found = cut(found) if k % 3 == 2 else found
    return found


def closure_of_edges(edges: DataFrame) -> DataFrame:
    """The closure of a graph of names: a label has the ancestors of all its parents (H01 on merged names)."""
    pairs, steps, cycles = _doubled(edges)
    edges = (steps[0] if steps else pairs).select(F.col("u").alias("parent"), F.col("v").alias("child"))
    tops = roots(edges)
    if not cycles:
        at = _depths(tops, steps)
    else:  # the labels of a cycle share the depths of one of them
        back = pairs.select(F.col("u").alias("_v"), F.col("v").alias("_u"))
        place = cut(pairs.join(back, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))).groupBy(F.col("u").alias("label")).agg(F.min("v").alias("place")))
        of = lambda c: edges.join(place.select(F.col("label").alias(c), F.col("place").alias(f"_{c}")), c, "left").select("parent", "child", F.coalesce(f"_{c}", c).alias(f"to_{c}"))
        merged = of("parent").join(of("child"), ["parent", "child"]).select(F.col("to_parent").alias("parent"), F.col("to_child").alias("child")).where("parent <> child")
        at = _depths(tops, _doubled(merged)[1])
        member = place.select(F.col("place").alias("_place"), F.col("label").alias("_member"))
        at = at.join(member, F.col("label") == F.col("_place"), "left").select(F.coalesce("_member", "label").alias("label"), "depth")
    return pairs.where("u <> v").join(at, F.col("u") == F.col("label")).select(F.col("v").alias("label"), "depth", F.col("u").alias("ancestor"))


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are no one's child."""
    return edges.select(F.col("parent").alias("label")).distinct().join(edges.select(F.col("child").alias("label")), "label", "left_anti")


def ancestors(closed: DataFrame) -> DataFrame:
    """(label, ancestor) at whatever depth."""
    return closed.select("label", "ancestor").distinct()


def descendants(edges: DataFrame) -> DataFrame:
    """(label, descendant) over names merged; a label of a cycle is its own descendant."""
    return _doubled(edges)[0].select(F.col("u").alias("label"), F.col("v").alias("descendant"))


def depths(labels: DataFrame, closed: DataFrame) -> DataFrame:
    """(label, node_depth): one more than the deepest ancestor, 1 without any."""
    deepest = closed.groupBy("label").agg((F.max("depth") + 1).alias("node_depth"))
    return labels.select("label").distinct().join(deepest, "label", "left").select("label", F.coalesce("node_depth", F.lit(1)).alias("node_depth"))


def under_root(labels: DataFrame, closed: DataFrame, root: str) -> DataFrame:
    """Rows whose label has the root at depth 1; the root itself has not."""
    return labels.join(closed.where((F.col("depth") == 1) & (F.col("ancestor") == root)).select("label").distinct(), "label", "left_semi")


def parents(edges: DataFrame, label: str) -> DataFrame:
    """The parents of a label."""
    return edges.where(F.col("child") == label).select("parent").distinct()


def top_branches(labels: DataFrame, closed: DataFrame) -> DataFrame:
    """Of each label the ancestors that have no ancestor but a root."""
    return labels.select("label").join(closed.where("depth = 2").select("label", F.col("ancestor").alias("branch")).distinct(), "label")


#: Ancestors up to so many are packed as bits, 62 a long; in vocabularies of up to ``MOST_LABELS`` whole sets are. Vocabularies up to so many bytes are broadcast.
MOST_BITS, MOST_LABELS, MOST_BYTES, BITS = 4096, 1000, 64 << 20, 62


@dataclass
class Ancestry:
    """``labels``: label, word and mask (the place of its bit), above (the bits of its ancestors), node_depth, rooted (whether the root stands at depth 1 above it). ``words``: longs of a bitmap of ancestors, None if there are too many; ``set_words``: of one of all labels, 0 if these are too many. ``small``: whether the labels may be broadcast."""

    labels: DataFrame
    words: int | None
    set_words: int
    small: bool

    def marked(self, rows: DataFrame, label: str = "label") -> DataFrame:
        """``rows`` with what is known of their labels; unknown labels have depth 1."""
        known = self.labels.withColumnRenamed("label", "_label")
        joined = rows.join(F.broadcast(known) if self.small else known, F.col(label) == F.col("_label"), "left").drop("_label")
        return joined.withColumns({"node_depth": F.coalesce("node_depth", F.lit(1)), "rooted": F.coalesce("rooted", F.lit(False))})

    def union(self, sets: Column) -> Column:
        """The bits of all ancestors of an array of labels (structs with ``above``)."""
        none = F.array(*[F.lit(0).cast("long")] * self.words).cast("array<long>")
        return F.aggregate(sets, none, lambda bits, x: F.when(x["above"].isNull(), bits).otherwise(F.zip_with(bits, x["above"], lambda a, b: a.bitwiseOR(b))))


def has_bit(bits: Column, label: Column) -> Column:
    """Whether a bitmap has the bit of a label, a struct with ``word`` and ``mask`` (H05); false of none."""
    return F.coalesce(F.get(bits, label["word"]).bitwiseAND(label["mask"]) != 0, F.lit(False))


def ancestry(closed: DataFrame, root: str | None = "Entity") -> Ancestry:
    """Every label of a closure with the bitmap of its ancestors (H05). Ancestors are numbered by name, then, in small vocabularies, the other labels."""
    closed = cut(closed)
    names = cut(closed.select(F.col("ancestor").alias("label"), F.lit(True).alias("inner")).unionByName(closed.select("label", F.lit(False).alias("inner"))).groupBy("label").agg(F.max("inner").alias("inner")))
    many = names.agg(F.count_if("inner").alias("inner"), F.count("*").alias("all")).first()
    words = -(-many.inner // BITS) if many.inner <= MOST_BITS else None
    set_words = -(-many["all"] // BITS) if words is not None and many["all"] <= MOST_LABELS else 0
    number = F.row_number().over(Window.orderBy(F.desc("inner"), "label")) - 1  # of a few thousand names
    listed = names.where(F.lit(words is not None) & (F.lit(bool(set_words)) | F.col("inner"))).select("label", number.alias("n"))
    listed = listed.select("label", F.floor(F.col("n") / BITS).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % BITS).cast("int")).alias("mask"))
    rows = closed.join(F.broadcast(listed.withColumnRenamed("label", "ancestor")), "ancestor", "left")
    above = F.array(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("mask"))), F.lit(0).cast("long")) for w in range(words or 0)]).cast("array<long>")
    rooted = F.max((F.col("depth") == 1) & (F.col("ancestor") == (root or "")))
    below = rows.groupBy("label").agg(above.alias("above"), (F.max("depth") + 1).alias("node_depth"), rooted.alias("rooted"))
    labels = names.select("label").join(below, "label", "left").join(listed, "label", "left")
    labels = cut(labels.select("label", "word", "mask", "above", F.coalesce("node_depth", F.lit(1)).alias("node_depth"), F.coalesce("rooted", F.lit(False)).alias("rooted")))
    return Ancestry(labels, words, set_words, many["all"] * (8 * (words or 0) + 64) <= MOST_BYTES)


def _ones(word: Column, base: int) -> Column:
    """The places of the ones of a long, counted from ``base``: as many steps as there are ones."""
    state = F.struct(word.alias("left"), F.array().cast("array<int>").alias("out"))
    low = lambda x: x.bitwiseAND(-x)
    step = lambda s, _: F.struct(s["left"].bitwiseAND(s["left"] - 1).alias("left"), F.concat(s["out"], F.array(F.bit_count(low(s["left"]) - 1) + base)).alias("out"))
    return F.when(word == 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.sequence(F.lit(1), F.bit_count(word)), state, step, lambda s: s["out"]))


def pseudo_leaves(sets: DataFrame, closed: DataFrame, key: str, label: str = "label", known: Ancestry | None = None) -> DataFrame:
    """The different rows (key, label) of sets, without those whose label is an ancestor of another label of the same key.

    In small vocabularies a key's labels and all their ancestors are one bitmap each, summed by a partial aggregate; what is in the first but not in the second stays.
    In larger ones each key's different labels come together and are tested by bits in their own row; beyond ``MOST_BITS`` ancestors, pairs of keys and ancestors are joined.
    Rows with a null key belong to no set and all stay, and so do labels that the closure doesn't have.
    """
    known = known or ancestry(closed)
    sets = sets.select(key, label)
    if known.words is None:
        names = closed.select(F.col("label").alias("_l"), F.col("ancestor").alias(label)).distinct()
        above = sets.select(key, F.col(label).alias("_l")).join(names, "_l").select(key, label).distinct()
        return sets.distinct().join(above, [key, label], "left_anti")
    marked = known.marked(sets, label)
    if known.set_words:
        own = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("mask"))), F.lit(0).cast("long")).alias(f"_s{w}") for w in range(known.set_words)]
        over = [F.coalesce(F.bit_or(F.get("above", F.lit(w))), F.lit(0).cast("long")).alias(f"_a{w}") for w in range(known.words)]
        packed = marked.where("word IS NOT NULL").groupBy(key).agg(*own, *over)
        free = lambda w: F.when(F.col(key).isNull(), F.col(f"_s{w}")).otherwise(F.col(f"_s{w}").bitwiseAND(F.bitwise_not(F.col(f"_a{w}")))) if w < known.words else F.col(f"_s{w}")
        places = F.concat(*[_ones(free(w), BITS * w) for w in range(known.set_words)])
        names = known.labels.where("word IS NOT NULL").select((F.col("word") * BITS + F.bit_count(F.col("mask") - 1)).alias("_place"), F.col("label").alias(label))
        kept = packed.select(key, F.explode(places).alias("_place")).join(F.broadcast(names), "_place").select(key, label)
        return kept.unionByName(marked.where("word IS NULL").select(key, label).distinct())
    one = F.struct(F.col(label).alias("label"), "word", "mask", "above")
    grouped = marked.groupBy(key).agg(F.collect_set(one).alias("_set")).withColumn("_above", known.union(F.col("_set")))
    kept = F.when(F.col(key).isNull(), F.col("_set")).otherwise(F.filter("_set", lambda x: ~has_bit(F.col("_above"), x)))
    return grouped.select(key, F.inline(kept)).select(key, F.col("label").alias(label))


def pseudo_leaves_or_all(sets: DataFrame, closed: DataFrame, key: str, label: str = "label") -> DataFrame:
    """The same; a key that would keep nothing, as in a cycle, keeps all."""
    kept = cut(pseudo_leaves(sets, closed, key, label))
    return kept.unionByName(sets.select(key, label).join(kept.select(key).distinct(), key, "left_anti").distinct())


def leaves_of_array(rows: DataFrame, labels: str, known: Ancestry) -> DataFrame:
    """``rows`` whose array of labels keeps its order and repeats, without labels that are ancestors of others in it, or all of it if none is left."""
    if not known.words or not known.small:
        raise ValueError("the vocabulary is too large to go with every row")
    vocabulary = known.labels.agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("word", "mask", "above")))).alias("_known"))
    joined = rows.crossJoin(F.broadcast(vocabulary))  # one row
    found = lambda x: F.try_element_at("_known", x)
    coded = F.transform(labels, lambda x: F.struct(x.alias("label"), *[found(x)[c].alias(c) for c in ("word", "mask", "above")]))
    joined = joined.withColumn("_coded", coded).withColumn("_above", known.union(F.col("_coded")))
    kept = F.transform(F.filter("_coded", lambda x: ~has_bit(F.col("_above"), x)), lambda x: x["label"])
    return joined.withColumn(labels, F.when(F.size(kept) > 0, kept).otherwise(F.col(labels))).select(*rows.columns)


def tree_lines(edges: DataFrame, indent: str = "  ") -> DataFrame:
    """The forest as text, (path, line) in the order of paths: roots and siblings by name."""
    down = edges.select(F.col("parent").alias("_parent"), F.col("child").alias("_child"))
    level = cut(roots(edges).select("label", F.array("label").alias("path")))
    every = level
    while not level.isEmpty():
        level = cut(level.join(down, F.col("label") == F.col("_parent")).where(~F.array_contains("path", F.col("_child"))).select(F.col("_child").alias("label"), F.concat("path", F.array("_child")).alias("path")))
        every = every.unionByName(level)
    return every.select("path", F.concat(F.repeat(F.lit(indent), F.size("path") - 1), F.col("label")).alias("line")).orderBy("path")


def save_closure(closed: DataFrame, path: str) -> None:
    """Keep a closure as a table, so that it is built once."""
    closed.select("label", "depth", "ancestor").write.mode("overwrite").parquet(path)


def saved_closure(spark: SparkSession, path: str) -> DataFrame:
    """The closure that a table holds."""
    return spark.read.schema("label string, depth int, ancestor string").parquet(path)
