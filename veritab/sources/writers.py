"""Tables, logs, results and trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing table is kept unless it may be overwritten."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines added to a log, committed file by file."""
    df.write.mode("append").json(path)


def results(records: DataFrame, metrics: DataFrame, path: str) -> None:
    """Records and, beside them, the metrics."""
    records.write.mode("overwrite").json(f"{path}/records")
    metrics.withColumn("total_samples", F.lit(records.count())).write.mode("overwrite").json(f"{path}/metrics")


def tree_text(lines: DataFrame, path: str) -> None:
    """An indented tree as one text file, in its order."""
    lines.orderBy("path").select("line").coalesce(1).write.mode("overwrite").text(path)


def run_config(df_or_spark, config: dict, path: str) -> None:
    """A run's settings as one row of JSON."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
