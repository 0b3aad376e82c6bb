"""The pipeline's stages give the same rows however their input lies, and take columns of any name."""

import collections
import time

from fixtures import documents
from pyspark.sql import functions as F

from veritab.llm import budget_mix
from veritab.llm._session import checkpointed, copies, counted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_ids(spark):
    """200 of 600 rows share one id with different texts of one length, some have null ids, some are equal; sources are taken in part."""
    rows = [(i, f"a{i} b c{i % 7} " + "d " * (i % 5)) for i in range(400)] + [(7, f"x{i} y z w") for i in range(150)] + [(None, f"n{i % 20} y z") for i in range(50)]
    docs = [(i, t, "en", "s0" if k % 2 else None if k % 14 == 0 else "s2", len(t)) for k, (i, t) in enumerate(rows)] + [(3, "equal row here", "en", "s1", 14)] * 37
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")


def many(df):
    return collections.Counter(df.select(*COLUMNS).collect())


def orders(docs):
    return [docs, docs.repartition(3), docs.repartition(7, "text"), docs.orderBy(F.desc("text")).coalesce(1)]


def test_mix_is_the_same_however_rows_lie(spark):
    docs = shared_ids(spark).cache()
    first, *others = [many(budget_mix.mixed_documents(d)) for d in orders(docs)]
    assert sum(first.values()) > 600 and len(set(first.values())) > 1 and all(o == first for o in others)
    words = collections.Counter()
    for r, n in first.items():
        words[r.source] += n * len(r.text.split())
    goal = {r.source: r.target for r in budget_mix.mixed(docs).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - goal[s]) <= 4 for s in goal)


def test_mix_takes_the_same_words_however_rows_lie(spark):
    docs = shared_ids(spark).cache()
    first, *others = [collections.Counter(budget_mix.mixed(d).collect()) for d in orders(docs)]
    assert all(o == first for o in others) and sum(first.values()) == docs.count()


def test_a_row_of_many_copies_is_planned_as_few_and_written_by_several_tasks(spark):
    docs = spark.range(200_000, numPartitions=4).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"{i} " * (i % 9 + 1), "en", "t", 3) for i in range(300)], docs.schema))
    got = budget_mix.mixed(docs)
    taken = {r.source: r.words for r in got.groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    goal = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    assert got.count() == 200_300 and all(abs(taken[s] - goal[s]) <= 9 for s in goal)
    assert counted(docs, ["doc_id", "source"]).where("source = 's'").count() <= 64
    parts = copies(counted(docs, ["doc_id", "source"]).repartition(4), "n").where("source = 's'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 200_000
    assert budget_mix.mixed_documents(docs).where("source = 's'").count() * 3 == taken["s"]


def test_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 25), ("d", 1)], "x string, n long")
    for chunk in (10_000, 10, 1):
        assert collections.Counter(r.x for r in copies(df, "n", chunk).collect()) == {"a": 3, "c": 25, "d": 1}
    assert copies(df, "n").columns == ["x"]


def through(spark, docs, folder, stages):
    """The documents after some stages, written and read again between them."""
    for k, (_, stage) in enumerate(stages):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def test_pipeline_is_the_same_however_rows_lie(spark, tmp_path):
    import corpus_pipeline

    docs = shared_ids(spark).cache()
    found = []
    for k, d in enumerate(orders(docs)[::3]):
        (tmp_path / str(k)).mkdir()
        found.append(many(through(spark, d, tmp_path / str(k), corpus_pipeline.STAGES[1:4])))
    assert found[0] == found[1] and found[0]


def test_stages_take_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["kept_rows", "kept_id", "row", "_row", "size", "n", "_h", "c0", "c1", "_key", "component_id", "_times", "_each", "rep"]
    docs = documents(spark).select(*COLUMNS, *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = through(spark, docs, tmp_path, corpus_pipeline.STAGES[:4])
    assert got.columns == COLUMNS + names and got.count() > 0
    assert got.select(*names).distinct().collect() == [tuple(range(len(names)))]
    assert corpus_pipeline.packing(spark, got, str(tmp_path)).count() >= got.count()


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    df = checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and df.agg(F.sum("count")).first()[0] == 1000
