"""Checkpoints in the folder that a cluster shares, and rows that the driver hands to a plan."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's files (elsewhere the path is no use and no harm)."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [held, root]))


#: Spark's setting by which a plan's shuffle files go when it has run. A lost one would be written again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in spark.checkpoint.dir. Only where that is unset on one machine, as in tests, in a folder of its own; a cluster must name one that its machines share.

    The shuffle files behind it go at once: else they stay until the driver collects its garbage, beside those of what follows.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veritab-checkpoint-"))
    conf = df.sparkSession.conf
    held = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan takes the setting as it is made
    finally:
        conf.set(CLEANUP, held)


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows known to the driver as a DataFrame, through a JSON literal: no RDD and no Python worker takes part."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def places(df: DataFrame, keys: list[str], order: list[Column], out: str, rows_per_block: int = 100_000, weight: str | None = None) -> DataFrame:
    """Gapless places from 0 within each group of ``keys``, in the order of ``order``, whose first column is a uniform 64-bit hash. With ``weight``, a row takes as many places as that column says, and ``out`` is its first.

    A group may hold any share of the rows: those with more than ``rows_per_block`` are cut into blocks by the leading bits of the
    hash, rows are numbered within blocks, and blocks are shifted by the summed counts of those before. Such groups are at most one in
    ``rows_per_block`` rows, and their blocks at most two, so both tables are broadcast. Rows that share a hash share a block: equal rows should come counted, as one row with a weight.
    """
    from pyspark.sql import Window

    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))]
    large = df.groupBy(*keys).count().where(F.col("count") > rows_per_block).select(*named, F.ceil(F.col("count") / rows_per_block).cast("long").alias("_blocks"))
    lead = F.shiftrightunsigned(order[0], 32)
    cut = df.join(F.broadcast(large), same, "left").drop(*drop).withColumn("_block", F.coalesce(F.floor(lead * F.col("_blocks") / F.lit(float(1 << 32))).cast("long"), F.lit(0)))
    taken = F.count("*") if weight is None else F.sum(weight)
    counts = cut.where("_blocks IS NOT NULL").groupBy(*keys, "_block").agg(taken.alias("count"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*named, F.col("_block").alias("_b"), before.alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    first = F.row_number().over(within).cast("long") - 1 if weight is None else F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_place", first)
    placed = ranked.join(F.broadcast(shifts), [*same, F.col("_block") == F.col("_b")], "left")
    return placed.withColumn(out, F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_blocks", "_block", "_b", "_place", "_before", *drop)


#: Equal rows are counted in so many parts, so that no task writes all copies of one.
PARTS_OF_EQUALS = 64


def counted(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Equal rows counted, each count in parts by where the rows lie: the parts differ with the partitions, what they add up to doesn't."""
    part = F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.spark_partition_id().cast("long")), F.lit(PARTS_OF_EQUALS))
    return df.select(*keys, part.alias("_part")).groupBy(*keys, "_part").agg(F.count("*").alias(out)).drop("_part")


def copies(df: DataFrame, many: str, chunk: int = 10_000) -> DataFrame:
    """Each row as often as the column ``many`` says, which goes; numbers are made in chunks, never as one long array."""
    chunks = df.where(F.col(many) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(chunk).cast("long"))))
    return chunks.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk).cast("long"), F.col(many) - F.col("_from"))))).drop("_from", many)
