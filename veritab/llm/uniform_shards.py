"""Uniform shuffle into shards of exact size with a hypergeometric communication matrix (operator 3, native).

Rows lie in partitions by a hash. How many rows of each partition go to each shard is drawn exactly, as a
uniform shuffle of all rows would have it: a matrix of multivariate hypergeometric counts whose column sums are the shard
sizes. Rows are permuted within their partition, dealt to shards by the cumulated counts, and permuted again within
their shard. The law is ``rows``: shard sizes differ by one row at most. Texts never move; only ids, sizes and checksums do.

The matrix has ``MOST_PARTITIONS`` rows at most, whatever the input: beyond, partitions hold more rows. So it is drawn on the driver and broadcast.

Defined results: a null text has no bytes (size 1, checksum 0). Rows that are equal in id, size and checksum are counted and
told apart by an ordinal, so they (and rows with a null id) spread like others. Repeated rows are separate
rows. An empty table gives no rows. The result depends on the rows and the seed alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._session import checkpointed, literal_rows, places

ROWS_PER_PARTITION, MOST_PARTITIONS = 50_000, 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` are good, without replacement. numpy's sampler ends at 10**9; beyond, the draws are halved by the law itself, or taken by rejection from a uniform hull."""
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    log = lambda k: -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    width = 1 + math.sqrt(draws * good * bad * max(1, total - draws) / (total * total * max(1, total - 1)))
    top = log(mode)
    while True:  # ratio of uniforms over the exact mass
        u = rng.random()
        k = mode + math.floor((rng.random() * 2 - 1) * 3 * width / max(u, 1e-300))
        if u and low <= k <= high and 2 * math.log(u) <= log(k) - top:
            return k


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts for each partition (row) and shard (column); rows sum to ``sizes``, columns to ``shards``."""
    rng, left, rows = np.random.default_rng(seed), list(shards), []
    for size in sizes:
        need, rest, row = size, sum(left), []
        for s, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, need)
            row.append(got)
            need -= got
            left[s] -= got
        rows.append(row)
    return rows


def shuffled_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Per row: doc_id, size (bytes of text plus 1), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    doc_id, text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").count().withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    hashed = lambda k: F.xxhash64(F.lit(seed + k), "doc_id", "text_crc32", "size", "ordinal")
    rows = checkpointed(rows.withColumns({"h0": hashed(0), "h1": hashed(1), "h2": hashed(2)}))
    total = rows.count()
    n = max(1, min(MOST_PARTITIONS, -(-total // rows_per_partition)))
    rows = rows.withColumn("part", F.pmod("h0", F.lit(n)))
    counts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a row for each partition, MOST_PARTITIONS at most
    parts = sorted(counts)
    order = np.random.default_rng(seed).permutation(n_shards)
    sizes = [total // n_shards + int(order[s] < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    bounds = [{"p": int(p), "cum": np.cumsum(row).tolist()} for p, row in zip(parts, matrix, strict=True)]
    ties = [F.col(c) for c in ("doc_id", "text_crc32", "size", "ordinal")]
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("h1", *ties)).cast("long") - 1)
    table = literal_rows(spark, bounds, "p: bigint, cum: array<bigint>") if bounds else spark.range(0).select(F.col("id").alias("p"), F.array(F.lit(0).cast("long")).alias("cum"))
    dealt = local.join(F.broadcast(table), F.col("part") == F.col("p")).withColumn("shard", F.size(F.filter("cum", lambda c: c <= F.col("rank"))))
    placed = places(dealt.select("doc_id", "size", "text_crc32", "ordinal", "shard", "h2"), ["shard"], [F.col("h2"), *ties], "slot", rows_per_partition)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
