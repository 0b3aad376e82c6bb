"""Distractors by an inverted index of the vocabulary: a question reads a few postings, and nothing has a row for each pair of labels.

``distractor_pools`` in ``sampling`` lists all pools of a label, which suits vocabularies of some thousands; here only the labels below each
ancestor are listed, so the index has as many entries as the closure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.checkpoints import stored
from veritab.operators.sampling import MOST_BROADCAST, rank_hash

#: Labels of a posting's chunk, about. A read takes one chunk, and further ones only where it gave fewer labels than a question can use.
CHUNK = 16
#: So many labels of a list are used at most: hard ones come first, of others as many may be taken before.
KEPT = {"hard": 1, "medium": 2, "easy": 3, "base": 3}
BANDS = ("hard", "medium", "easy")


def number_of(text: Column) -> Column:
    """32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def label_index(vocabulary: DataFrame, closed: DataFrame, root: str = "Entity") -> tuple[DataFrame, DataFrame]:
    """Records (y_true, up, at_hard, at_medium, reads) and chunks (node, chunk, members) of a vocabulary's labels.

    A node is an ancestor at a depth, "depth/ancestor", and the root's lists all labels below it; ``reads`` are the nodes of a label's bands with their numbers of chunks. Bands are
    those of ``distractor_pools``: with L the deepest ancestor's depth (2 at least), labels sharing an ancestor at L, at L - 1 but not L, and at L - 2 but neither. A label without ancestors reads the root alone.
    """
    node = F.concat_ws("/", F.col("depth").cast("string"), "ancestor")
    own = closed.groupBy("label").agg(
        F.collect_set("ancestor").alias("up"),
        F.collect_set(F.when(F.col("depth") > 1, F.struct("depth", node.alias("node")))).alias("at"),
        F.max(F.when(F.col("depth") > 1, F.col("depth"))).alias("top"),
        F.max((F.col("depth") == 1) & (F.col("ancestor") == root)).alias("rooted"),
    )
    known = vocabulary.select("label").where("label IS NOT NULL").distinct().join(own, "label", "left")
    nothing = F.array().cast("array<string>")
    known = known.withColumns({"up": F.coalesce("up", nothing), "at": F.coalesce("at", F.array().cast(own.schema["at"].dataType)), "top": F.coalesce("top", F.lit(2))})
    known = stored(known.withColumn("nodes", F.transform("at", lambda a: a["node"])))

    listed = known.where("rooted").select(F.explode(F.concat("nodes", F.array(F.lit("root")))).alias("node"), F.col("label").alias("x"), F.col("up"), F.col("nodes").alias("at"))
    sizes = listed.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    chunk = F.pmod(number_of(F.col("x")), F.col("chunks"))
    chunks = listed.join(sizes, "node").groupBy("node", chunk.alias("chunk")).agg(F.collect_list(F.struct("x", "up", "at")).alias("members"))

    lm, le = F.greatest(F.lit(2), F.col("top") - 1), F.greatest(F.lit(2), F.col("top") - 2)
    at = lambda depth: F.transform(F.filter("at", lambda a: a["depth"] == depth), lambda a: a["node"])
    levels = known.select(F.col("label").alias("y_true"), "up", at(F.col("top")).alias("at_hard"), F.when(lm < F.col("top"), at(lm)).otherwise(nothing).alias("at_medium"), F.when(le < lm, at(le)).otherwise(nothing).alias("at_easy"))
    named = lambda b: F.transform(f"at_{b}", lambda n: F.struct(F.lit(b).alias("band"), n.alias("node")))
    every = F.concat(*map(named, BANDS), F.array(F.struct(F.lit("base").alias("band"), F.lit("root").alias("node"))))
    reads = levels.select("y_true", F.explode(every).alias("r")).select("y_true", "r.*").join(sizes, "node").groupBy("y_true").agg(F.collect_list(F.struct("band", "node", "chunks")).alias("reads"))
    return stored(levels.drop("at_easy").join(reads, "y_true", "left")), stored(chunks)


def _first_labels(reads: DataFrame, chunks: DataFrame, small: bool, seed: int) -> DataFrame:
    """(_q, band, node, hits): the first labels of each read's posting that the question may take, from its own first chunk on.

    Chunks come in an order that starts at a hash of key and node and goes around; within a chunk labels come by the hash of key and label, ``i`` is a label's place there. Each further
    round takes four times the chunks of those before, for reads that are not satisfied, so that even a posting without any fitting label ends after a few rounds.
    """
    table = F.broadcast(chunks) if small else chunks.hint("merge")
    key, x = F.col("_key"), lambda m: m["x"]
    start = F.pmod(number_of(F.concat_ws("-", F.lit(str(seed)), key, "node")), F.col("chunks"))
    free = lambda m, name: ~F.arrays_overlap(m["at"], F.col(name))
    kept = F.coalesce(*[F.when(F.col("band") == b, F.lit(n)) for b, n in KEPT.items()])

    def fits(m: Column) -> Column:
        other = ~x(m).eqNullSafe(F.col("y_true")) & ~F.array_contains("up", x(m)) & ~F.array_contains(m["up"], F.col("y_true"))
        other &= ~F.coalesce(F.array_contains("_excluded", x(m)), F.lit(False))
        band = F.col("band")
        return other & (band.isin("hard", "base") | (free(m, "at_hard") & ((band == "medium") | free(m, "at_medium"))))

    found, left, low, high = [], reads.withColumns({"_start": start, "_have": F.lit(0)}), 0, 1
    held = ["_key", "y_true", "up", "at_hard", "at_medium", "_excluded", "_start"]
    while True:
        steps = left.withColumn("_step", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), F.col("chunks")) - 1)))
        steps = steps.withColumn("chunk", F.pmod(F.col("_start") + F.col("_step"), F.col("chunks"))).join(table, ["node", "chunk"], "left")
        ranked = F.array_sort(F.transform(F.filter("members", fits), lambda m: F.struct(rank_hash(seed, key, x(m)).alias("h"), x(m).alias("x"))))
        hits = F.transform(F.slice(ranked, F.lit(1), kept), lambda r, i: F.struct(F.col("_step").alias("step"), i.alias("i"), r["x"].alias("x")))
        got = steps.withColumn("hits", F.coalesce(hits, F.array().cast("array<struct<step:bigint,i:int,x:string>>"))).drop("members", "chunk", "_step")
        if high - low > 1:
            rest = [c for c in got.columns if c != "hits"]
            got = got.groupBy(*rest).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).withColumn("hits", F.slice("hits", F.lit(1), kept))
        got = got.withColumn("_have", F.col("_have") + F.size("hits"))
        open_ = (F.col("_have") < kept) & (F.col("chunks") > high)
        got = stored(got.withColumns({c: F.when(open_, F.col(c)) for c in held}).withColumn("_open", open_))  # what is done no longer needs its arrays
        found.append(got.where(F.size("hits") > 0).select("_q", "band", "node", "hits"))
        left = got.where("_open").drop("hits", "_open")
        low, high = high, high * 4 + 1
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def indexed_distractors(questions: DataFrame, index: tuple[DataFrame, DataFrame], key: str, seed: int = 42, excluded: str | None = None) -> DataFrame:
    """``questions`` (key, y_true, and perhaps an array of labels to exclude) with hard, medium and easy: distinct labels, each the first of its band that is left.

    Hard falls back to medium, medium to easy, and all to any label below the root; the true label stands where there is none. A band's order goes by its nodes' hashes, then as ``_first_labels`` says.
    Rows of equal key, label and exclusions get equal labels; a label that the vocabulary lacks, or null, gets itself.
    """
    records, chunks = index
    small = (chunks.agg(F.sum(F.size("members"))).first()[0] or 0) <= MOST_BROADCAST
    asked = [key, "y_true", *([excluded] if excluded else [])]
    slim = questions.select(F.col(key).alias("_key"), F.col("y_true"), (F.col(excluded) if excluded else F.array().cast("array<string>")).alias("_excluded")).distinct()
    # Rows go by a number of their own: keys and exclusions travel once, to the end.
    named = slim.join(F.broadcast(records) if small else records, "y_true").where("reads IS NOT NULL").withColumn("_q", F.monotonically_increasing_id())
    named = stored(named)

    def merged(bands: list[str], of: DataFrame) -> DataFrame:
        """The reads of some bands that gave labels, for each question in one row."""
        reads = of.select("_q", "_key", "y_true", "up", "at_hard", "at_medium", "_excluded", F.explode("reads").alias("_r")).select("*", "_r.*").drop("_r").where(F.col("band").isin(bands))
        return _first_labels(reads, chunks, small, seed)

    def listed(band: str) -> Column:
        """A band's labels in their order: by the hash of key and node, then as they were read."""
        own = F.filter("_found", lambda f: f["band"] == band)
        each = F.transform(own, lambda f: F.transform(f["hits"], lambda h: F.struct(rank_hash(seed, F.col("_key"), f["node"]).alias("n"), h["step"].alias("step"), h["i"].alias("i"), h["x"].alias("x"))))
        return F.coalesce(F.array_sort(F.flatten(each)), F.array().cast("array<struct<n:string,step:bigint,i:int,x:string>>"))

    # Of many labels one band after the other, so that one band's reads are under way at a time.
    found = reduce(DataFrame.unionByName, [merged(bands, named) for bands in ([list(BANDS)] if small else [[b] for b in BANDS])])
    many = lambda band: F.coalesce(F.sum(F.when(F.col("band") == band, F.size("hits"))), F.lit(0))
    full = found.groupBy("_q").agg(*[many(b).alias(b) for b in BANDS]).where("hard + medium >= 1 AND easy >= 3").select("_q")
    # Only questions whose bands may run out read the root's list.
    found = found.unionByName(merged(["base"], named.join(full, "_q", "left_anti")))
    by_question = found.groupBy("_q").agg(F.collect_list(F.struct("band", "node", "hits")).alias("_found"))
    told = named.select("_q", "_key", "y_true", "_excluded").join(by_question, "_q", "left")
    told = told.withColumns({b: listed(b) for b in KEPT}).drop("_q", "_found")
    ids = ["_k", "_y", "_e"]
    told = told.withColumnsRenamed({"_key": "_k", "y_true": "_y", "_excluded": "_e"})
    taken: list[str] = []
    for name, order in (("hard", ("hard", "medium", "base")), ("medium", ("medium", "easy", "base")), ("easy", ("easy", "base"))):
        free = lambda r: reduce(lambda ok, t: ok & ~r["x"].eqNullSafe(F.col(t)), taken, F.lit(True))
        told = told.withColumn(f"_{name}", F.coalesce(*[F.try_element_at(F.filter(b, free), F.lit(1))["x"] for b in order], F.col("_y")))
        taken.append(f"_{name}")
    told = stored(told.select(*ids, *taken))
    match = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(asked, ids)]
    out = questions.join(told, reduce(lambda p, q: p & q, match), "left")
    return out.select(*questions.columns, *[F.coalesce(f"_{b}", "y_true").alias(b) for b in BANDS])
