"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, personal data, source mix, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``. Stages may be written and read again between calls, as the check tool does; ``run`` composes them.

Every stage takes an empty table and gives none, keeps columns beside those it names, and takes a null text as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import best_fit_packing, budget_mix, feistel_pseudonyms, parity_join, positive_unlabelled
from veritab.llm.queries import pseudonym_key, tokenizer

#: SQL can express neither the learnt scores nor the seeded choices.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay, repeated rows and null ids as well; null and empty texts score the model's bias."""
    model = positive_unlabelled.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(positive_unlabelled.score(model)(docs["text"]) < positive_unlabelled.THRESHOLD)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows that share an id are one document, of which the row that is first by text and then the other columns stays. Rows with a null id are in no group and all stay,
    and so do documents without words.
    """
    kept_id, kept_rows, row = _unused(docs, "kept_id"), _unused(docs, "kept_rows"), _unused(docs, "row")
    kept = parity_join.linked_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias(kept_rows))
    found = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(kept_id))).drop(kept_id)
    repeated = F.col("doc_id").isNotNull() & (F.col(kept_rows) > 1)
    rest = [c for c in docs.columns if c != "text"]
    first = found.where(repeated).groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias(row))
    return found.where(~repeated).select(*docs.columns).unionByName(first.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def _unused(docs: DataFrame, name: str) -> str:
    """A column's name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid numbers, dates and addresses in texts become pseudonyms; no row goes, and n_chars follows the text (null for a null text)."""
    changed = docs.withColumn("text", feistel_pseudonyms.replaced(pseudonym_key(spark))(docs["text"])["text"])
    return changed.withColumn("n_chars", F.char_length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, twice; such without words never. A null source is a source of its own."""
    return budget_mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is its end id alone."""
    return best_fit_packing.packed(docs, tokenizer())


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
