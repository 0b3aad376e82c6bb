"""A log of responses that grows while it is scored: the batch replay as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.sources.readers import RESPONSES, parsed_log


def responses(spark: SparkSession, path: str, schema: str = RESPONSES) -> DataFrame:
    """The valid records of all log files as they arrive, with the time and file of each."""
    lines = spark.readStream.format("text").load(path).select("value", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f")).alias("line_no"))
    return parsed_log(lines, schema)


#: A table's rows lie in so many buckets by key; a micro-batch rewrites those that its keys fall in.
BUCKETS = 64


def _current(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder that holds each bucket now: its newest version that is whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for version in fs.listStatus(at) if fs.exists(at) else []:
        name = version.getPath().getName()
        if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(version.getPath(), "_SUCCESS")):
            for bucket in fs.listStatus(version.getPath()):
                folder = bucket.getPath().getName()
                if folder.startswith("bucket="):
                    b = int(folder[7:])
                    newest[b] = max(newest.get(b, (-1, "")), (int(name[1:]), f"{path}/{name}/{folder}"))
    return {b: p for b, (_, p) in newest.items()}


def latest_table(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each key, as of the last micro-batch."""
    folders = list(_current(spark, path).values())
    if not folders:
        raise FileNotFoundError(f"no micro-batch has ended in {path}")
    return spark.read.parquet(*folders)


def latest_into(stream: DataFrame, path: str, checkpoint: str, key: str = "sample_idx"):
    """A query that keeps the last record of each key in a table; each micro-batch merges into the buckets that its keys fall in.

    A micro-batch writes its buckets into a version of its own, so one that is run again replaces what it had written.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        batch = bucketed(batch).persist()
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        # Versions before this one: a repeated micro-batch must not read what it wrote.
        held = [p for b, p in _current(spark, path).items() if b in touched and f"/v{batch_id}/" not in p]
        every = batch.unionByName(bucketed(spark.read.parquet(*held))) if held else batch
        last = every.groupBy("bucket", key).agg(F.max(F.struct(*rest)).alias("_r")).select("bucket", key, *[f"_r.{c}" for c in rest])
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
