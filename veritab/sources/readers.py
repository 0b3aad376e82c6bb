"""Tables, JSON documents and response logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Spark's file systems exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, name: str, data_root: str | None = None, hub: dict[str, str] | None = None) -> str:
    """The path of a dataset: itself if it exists, else under the data root, else in a mapping of published names; a name without a slash is an error."""
    tried = [name] + ([f"{data_root.rstrip('/')}/{name}"] if data_root else [])
    for path in tried:
        if exists(spark, path):
            return path
    if "/" not in name:
        raise ValueError(f"{name} is neither a path nor a published name")
    if hub and name in hub:
        return hub[name]
    raise FileNotFoundError(f"none of {tried} exists")


def table(spark: SparkSession, name: str, data_root: str | None = None, hub: dict[str, str] | None = None) -> DataFrame:
    return spark.read.parquet(resolve(spark, name, data_root, hub))


#: Up to so many bytes a core, rows of few files are dealt out before costly work.
SMALL_BYTES = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, with its rows dealt to all cores; any other as it is.

    A file with one row group is one task, whatever its rows cost. Large tables have splits enough, and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def partitioned(spark: SparkSession, pattern: str, depth: int = 2, names: tuple[str, ...] = ("split", "kind")) -> DataFrame:
    """All tables that a pattern of folders matches, with the folders' names as columns."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(pattern).withColumn("_parts", F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/"))
    for i, n in enumerate(reversed(names)):
        df = df.withColumn(n, F.element_at("_parts", F.lit(-2 - i)))
    return df.drop("_parts")


def numbered(df: DataFrame, order: list[str], column: str = "row_no") -> DataFrame:
    """Rows numbered from 0 in the order of columns that tell them apart. Counts of range partitions come first, so no task takes all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("_p").alias("_q"), "_before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_i", place).join(F.broadcast(counts), F.col("_p") == F.col("_q")).withColumn(column, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_q", "_i", "_before")


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A whole file as one document: an object, or a row for each element of an array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_by_key(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file of one object keyed by ids as rows (key: bigint, value), keys that are no numbers null."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{value}>"))).alias("e")).select(F.col("e.key").try_cast("long").alias("key"), F.col("e.value").alias("value"))


def json_or_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines for .jsonl, else a JSON document; blank lines are none."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


RESPONSES = "sample_idx string, question_id string, image_id string, responses array<string>, timestamp string"


def parsed_log(lines: DataFrame, schema: str = RESPONSES, key: str = "sample_idx") -> DataFrame:
    """Rows (line_no, value) parsed; blank and malformed lines and such whose key is no whole number outside quotes go."""
    raw = F.get_json_object("value", f"$.{key}")
    parsed = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    quoted = F.col("value").rlike(rf'"{key}"\s*:\s*"')
    return parsed.where(raw.try_cast("long").isNotNull() & ~quoted & F.coalesce(raw.rlike(r"^-?\d+$"), F.lit(False))).select("line_no", raw.cast("long").alias(key), *[F.col(f"_r.{f.name}") for f in T._parse_datatype_string(schema).fields if f.name != key])


def latest(parsed: DataFrame, key: str = "sample_idx") -> DataFrame:
    """The last record of each key."""
    rest = [c for c in parsed.columns if c not in (key, "line_no")]
    return parsed.groupBy(key).agg(F.max(F.struct("line_no", *rest)).alias("_r")).select(key, *[f"_r.{c}" for c in rest])


def response_log(spark: SparkSession, path: str, schema: str = RESPONSES) -> DataFrame:
    """The last response of each sample in a log of JSON lines (S06). Lines are ordered by file and place in it."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("line_no"))
    return latest(parsed_log(lines, schema))


def vocabulary(df: DataFrame, array: str) -> DataFrame:
    """The distinct labels of an array column, in a stable order of their own."""
    labels = df.select(F.explode(array).alias("label")).where("label IS NOT NULL").distinct()
    return labels.withColumn("ord", F.row_number().over(Window.orderBy("label")) - 1)


def classes(spark: SparkSession, names: list[str] | str) -> DataFrame:
    """(class_id, name) of a matching vocabulary, from a list or a text file with a name a line."""
    if isinstance(names, str):
        names = [r.value for r in spark.read.text(names).where(F.trim("value") != "").collect()]  # a vocabulary, read once
    return spark.createDataFrame(list(enumerate(names)), "class_id int, name string")


def attack_config(text: str) -> dict:
    """An attack's configuration with its patterns; a missing part is an error."""
    import json

    config = json.loads(text)
    for name in ("global", "patterns"):
        if name not in config:
            raise ValueError(f"the configuration has no {name}")
    return config
