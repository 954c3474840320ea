"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of `documents`. A stage works on all that the stage
before it kept, and its decisions take effect: rejected documents are gone, personal data is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm import bpe, contamination, jaccard, quality, surrogates
from revtide.session import scratch_path

SHINGLE, PERCENT = 5, 80
TOKENIZER_FILE: str | None = None  # the public 49k word vocabulary unless set


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted to their labels, does not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data."""
    return surrogates.pseudonymise(docs, surrogates.SECRET)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and digests of ids and decoded text."""
    encoded = bpe.encode_decode(docs, bpe.tokenizer_path(TOKENIZER_FILE))
    return bpe.digest(encoded, more=[F.col("ids")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("BPE encoding and decoding", bpe_coding),
]

# The model of the first stage is out of SQL's reach; tests check every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
