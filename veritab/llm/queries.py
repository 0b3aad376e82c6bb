"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import (
    best_fit_packing, budget_mix, centroid_clustering, feistel_pseudonyms, multi_index, oracles, parity_join, positive_unlabelled, prefix_targets, suffix_dedup, threshold_topk, tree_dedup, uniform_shards, vector_codes,
)
from veritab.sources.readers import dealt

#: The key of the registered queries where none is set: public, so whoever reads this can invert their pseudonyms.
DEMONSTRATION_KEY = "veritab pseudonyms, version 1"


def tokenizer() -> str:
    """The tokenizer's file: VERITAB_TOKENIZER, or the one of the public vocabularies installed beside Python."""
    if path := os.environ.get("VERITAB_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret in the session's setting spark.veritab.pseudonym.key or in VERITAB_PSEUDONYM_KEY; the queries run with a public one where neither is set."""
    return (spark.conf.get("spark.veritab.pseudonym.key", None) or os.environ.get("VERITAB_PSEUDONYM_KEY") or DEMONSTRATION_KEY).encode()


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_substrings(_read(spark, sf_dir, "documents"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards.shuffled_shards(_read(spark, sf_dir, "documents"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked_documents(_read(spark, sf_dir, "documents"))


def op5_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mixed(_read(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive_unlabelled.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pseudonyms.pseudonymised(_read(spark, sf_dir, "documents"), pseudonym_key(spark))


def op9_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_dedup.removed_passages(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed(_read(spark, sf_dir, "documents"), tokenizer())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clustered(_read(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_read(spark, sf_dir, "embeddings"))


def op13_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_targets.read_back(prefix_targets.examples(turns.unionByName(prefix_targets.hostile(spark))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_threshold_topk, op3_uniform_shards, op4_parity_join, op5_budget_mix, op6_multi_index, op7_positive_unlabelled, op8_feistel_pseudonyms, op9_tree_dedup, op10_best_fit_packing,
        op11_centroid_clustering, op12_vector_codes, op13_prefix_targets,
    )
}
ORACLE_SQL = {
    "op2_threshold_topk": oracles.THRESHOLD_TOPK,
    "op4_parity_join": oracles.PARITY_JOIN,
    "op6_multi_index": oracles.MULTI_INDEX,
    "op9_tree_dedup": oracles.TREE_DEDUP,
    "op11_centroid_clustering": oracles.CENTROID_CLUSTERING,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_prefix_targets": oracles.PREFIX_TARGETS,
}
