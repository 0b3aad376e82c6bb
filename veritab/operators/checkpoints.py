"""Lineage cuts in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a plan's shuffle files go when it has run. A lost one would be written again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Plans made and run herein leave no shuffle files behind."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut by compressed files beside the checkpoints, for large tables: a checkpoint's rows take several times the room."""
    spark = df.sparkSession
    path = folder(spark)
    with _cleaned(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir. Only where that is unset on one machine, as in tests, in a folder of its own; a cluster must name one that its machines share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veritab-"))
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()  # a plan takes the setting as it is made


def folder(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints, where all machines see what is written."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{context.getCheckpointDir()}/{uuid.uuid4()}"
