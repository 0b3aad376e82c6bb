"""Mixing sources to target weights by subset-sum budget fitting (operator 5).

Documents are counted by source and exact length. A source takes whole passes of itself while its target allows; for
the rest of its budget an even share of every length is the start, and bounded-knapsack dynamic programming over
documents to add and documents to give back finds the sum of lengths nearest to the target, on either side of it. Sums within
``WINDOW`` words of the start are looked through; sources of fewer words are so decided exactly, and in larger ones the start is within a
document's length of the target already. Then as many documents of each length are picked, in seeded order.

Defined results: of two sums that are equally near the lower is taken; a null text has size 0 and a null source is a source of its own, after the others. Targets use 150 % of
all sizes by default; none is above twice its source's size. Documents of size 0 take nothing. Repeated rows are separate
rows, counted while they are planned, so that a row repeated any number of times is planned as a few and written by several tasks. Reruns agree, whatever the partitions.
Rows that share an id, a source and a size but not their text are ordered by content in one block. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._session import attach, checkpointed, copies, counted, places

WEIGHTS = (5, 2, 1)
WINDOW = 40_000


def word_counts(docs: DataFrame, keys: dict, text_col: str = "text") -> DataFrame:
    """``size``: words ``[^\\x20\\x09-\\x0D]+`` of each text, beside the columns ``keys``."""
    attach(docs.sparkSession)
    flat = docs.select(*[c.alias(k) for k, c in keys.items()], docs[text_col].cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]) + ", size long"

    def count(batches):
        for b in batches:
            # bytes.split() cuts at \x20 and \x09 to \x0D and nowhere else
            sizes = [0 if x is None else len(x.split()) for x in b.column(b.num_columns - 1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], [*b.schema.names[:-1], "size"])

    return flat.mapInArrow(count, schema)


def _share(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """An even share of every length, each rounded so that what was lost or gained before is made up for; long documents first."""
    total, took = float((lengths * counts).sum()), np.zeros(len(lengths), np.int64)
    wished = given = 0.0
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0:
            wished += budget * float(lengths[i]) * float(counts[i]) / total
            took[i] = min(int(counts[i]), max(0, round((wished - given) / float(lengths[i]))))
            given += float(took[i]) * float(lengths[i])
    return took


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take, so that the sum of their lengths is as near to ``budget`` as sums within ``window`` of an even share come."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    took = _share(lengths, counts, budget)
    start = int((took * lengths).sum())
    # reached[low + s]: whether documents added and given back can change the start by s; by[low + s]: the item that did so first.
    low, high = min(start, max(window, int(abs(budget - start)))), min(total - start, max(window, int(abs(budget - start)) + 1))
    reached, by, items = np.zeros(low + high + 1, bool), np.full(low + high + 1, -1, np.int64), []
    reached[low] = True
    wanted = low + budget - start
    # The nearest sums there can be: the lower of two that are equally near comes first.
    best = [k for k in sorted({int(np.floor(wanted)), int(np.ceil(wanted))}, key=lambda k: (abs(k - wanted), k)) if 0 <= k <= low + high][:1]
    for i in np.argsort(lengths, kind="stable")[::-1]:
        for sign, many in ((1, int(counts[i] - took[i])), (-1, int(took[i]))):
            k, weight = 1, 0
            while many and lengths[i] > 0 and not (best and reached[best[0]]):
                k = min(k, many)
                weight = k * int(lengths[i])
                if weight > low + high:
                    break
                # Each count is split into powers of two, and each such item is added once at most.
                fresh = np.zeros(low + high + 1, bool)
                if sign > 0:
                    fresh[weight:] = reached[: len(reached) - weight]
                else:
                    fresh[: len(reached) - weight] = reached[weight:]
                fresh &= ~reached
                if fresh.any():
                    reached |= fresh
                    by[fresh] = len(items)
                items.append((i, sign * k, sign * weight))
                many, k = many - k, 2 * k
    sums = np.flatnonzero(reached)
    s = int(sums[np.argmin(np.abs(sums - wanted))])
    while s != low:
        i, k, weight = items[by[s]]
        took[i], s = took[i] + k, s - weight
    return took


def _fit_source(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
    passes = int(target // size) if size else 0
    order = np.argsort(pdf["size"].to_numpy(np.int64), kind="stable")
    lengths, counts = pdf["size"].to_numpy(np.int64)[order], pdf.n.to_numpy(np.int64)[order]
    took = fit(lengths, counts, target - passes * size, window) if size else np.zeros_like(counts)
    return pd.DataFrame({"source": pdf.source.iloc[0], "size": lengths, "passes": passes, "extra": np.where(lengths > 0, took, 0)})


def targets(histogram: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source_size and target of every source: weights repeat over sources in code point order; a source's excess over ``most`` times its size goes to the others by weight."""
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    # In the order of cap per weight, sources are full up to the first whose cap is above its share of what the full ones leave.
    cap = F.col("source_size") * F.lit(most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    every, so_far = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))
    rate = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
    rated = weighed.withColumn("cap", cap).withColumn("rate", rate)
    level = F.first(F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.col("rate")), ignorenulls=True).over(every)
    return rated.withColumn("level", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _planned(sized: DataFrame, equals: list[str], first: Column, share: float, most: float, weights: tuple[int, ...], rows_per_block: int, window: int) -> DataFrame:
    """Of rows counted by ``equals`` (doc_id, source, size and perhaps more): n, source_size, target, the passes that all of them get and ``extra``: how many of them get one more. ``first``: the seeded hash that orders rows of one length."""
    rows = checkpointed(counted(sized, equals))
    histogram = checkpointed(rows.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goal = checkpointed(targets(histogram, share, most, weights))
    known = histogram.join(goal, histogram["source"].eqNullSafe(goal["source"])).select(histogram["source"], "size", "n", "source_size", "target")
    fitted = checkpointed(known.groupBy("source").applyInPandas(lambda pdf: _fit_source(pdf, window), "source string, size long, passes long, extra long"))
    plan = fitted.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "passes", F.col("extra").alias("_all"), "source_size", "target")
    ranked = places(rows.withColumn("_h", first), ["source", "size"], [F.col("_h"), *[F.col(c) for c in equals]], "_rank", rows_per_block, "n")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    return joined.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("_all") - F.col("_rank")))).select(*equals, "n", "source_size", "target", "passes", "extra")


def _seeded(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", "size")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 29, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rows_per_block: int = 100_000, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target (its source's), taken (words the mix takes: 0, 1 or 2 times size)."""
    sized = word_counts(docs, {"doc_id": docs[id_col].cast("long"), "source": docs[source_col].cast("string")}, text_col)
    planned = _planned(sized, ["doc_id", "source", "size"], _seeded(seed), share, most, weights, rows_per_block, window)
    some = lambda passes, many: F.struct((F.col("size") * passes).alias("taken"), many.alias("many"))
    split = planned.withColumn("_s", F.explode(F.array(some(F.col("passes") + 1, F.col("extra")), some(F.col("passes"), F.col("n") - F.col("extra")))))
    return copies(split.select("doc_id", "source", "size", "source_size", "target", "_s.taken", F.col("_s.many").alias("_many")), "_many")


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 29, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", rows_per_block: int = 100_000, window: int = WINDOW) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Rows are told apart by a sha256 of all their columns, so which of several rows with one id the mix takes depends on
    their content, never on their order or partitions; rows that are equal in all columns are the same to the mix.
    """
    # All columns travel as one: as separate aliases beside a hash of them all, the optimizer would try all sets of names in that hash.
    whole = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    row = F.sha2(F.to_json(whole), 256)
    sized = word_counts(docs, {"doc_id": docs[id_col].cast("long"), "source": docs[source_col].cast("string"), "row": row}, text_col)
    first = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "row")).otherwise(_seeded(seed))
    planned = _planned(sized, ["doc_id", "source", "size", "row"], first, share, most, weights, rows_per_block, window)
    taken = planned.where("size > 0").groupBy("row").agg(F.sum(F.col("passes") * F.col("n") + F.col("extra")).alias("_times"), F.sum("n").alias("_rows"))
    times = checkpointed(taken.where("_times > 0").select(F.col("row").alias("_row"), F.expr("_times div _rows").alias("_each"), (F.col("_times") % F.col("_rows")).alias("_rest")))
    named = docs.select(whole.alias("_c"), row.alias("_key"))
    each = copies(named.join(times.where("_each > 0"), F.col("_key") == F.col("_row")).select("_c", "_each"), "_each")
    # Of equal rows that a length's last place divides, one stands for those that get a pass more: one group a source and length at most.
    one = named.join(times.where("_rest > 0"), F.col("_key") == F.col("_row")).groupBy("_row").agg(F.first("_c").alias("_c"), F.first("_rest").alias("_rest"))
    mix = each.unionByName(copies(one.select("_c", "_rest"), "_rest"))
    return mix.select(*[F.col("_c")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
