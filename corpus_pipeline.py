"""A corpus pipeline of the training-data operators.

Each stage gets what the one before kept, as Parquet, and returns the columns of documents; the last returns
packed pieces.  SQL can express only the mixing stage, so the pipeline has no SQL of its own; its test applies
brute-force versions of the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veil.llm.common import shared_dir
from veil.llm.language_id import keep_identified
from veil.llm.mixing import mixed_rows
from veil.llm.ngram_join import keep_one_of_each
from veil.llm.packing import pack
from veil.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is known well enough go."""
    return keep_identified(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until their sources meet the target weights."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of training sequences; workers that other stages have used keep fewer words."""
    return pack(docs, keep=200_000)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
