"""One thin query per corpus operator over the driver's tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hamming, kmeans_tree, language, minmax, mixing, packing, repeats, secrets, sharding, suffix_tree
from .shared import table


def tokenizer_files() -> dict[str, str]:
    """The production tokenizer: one vocabulary in two libraries' formats."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(table(spark, sf_dir, "documents"), **tokenizer_files()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_plan(table(spark, sf_dir, "documents"))


def op4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every embedding whose vec_id is divisible by 100."""
    found = hamming.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.classes(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(sharding.sized(table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language, op3_mixing, op4_hamming, op5_repeats, op6_kmeans_tree, op7_suffix_tree, op8_minmax, op9_sharding, op10_secrets)
}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE_SQL, "op4_hamming": hamming.ORACLE_SQL}
