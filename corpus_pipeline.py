"""A training-corpus pipeline of five operators: each stage works on all rows that the one before it kept.

language       documents whose language cannot be told go
near_copies    of each class of near-duplicates the document of least id stays
secrets        found secrets are masked in the text
mixture        documents repeat, or go, so that sources meet their target weights
packing        token windows: the pieces of all documents

The first four return the columns of ``documents``; the last returns one row per piece.  Nulls, empty texts, repeated
rows and empty tables have the results that each operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import language, minmax, mixing, packing, secrets
from brindle.llm.queries import tokenizer_files
from brindle.llm.shared import folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, **tokenizer_files()))


STAGES = [("language", identify), ("near_copies", near_copies), ("secrets", mask_secrets), ("mixture", mixture), ("packing", pack)]
#: Compression, hashing and tokenizers have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written as Parquet and read again as the next one's input.

    The files lie in the shared folder and go when the driver's Python ends.
    """
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
