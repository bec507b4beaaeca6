"""Input adapters: documents, turns and pages as texts (doc_key, block_id, text), and stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "v int, origin string, stickers array<struct<id: string, kind: string, label: string, selector: string, textHmac: string, updatedAt: bigint>>,"
    " dismissedSuggestions array<string>, customDetectors array<struct<id: string, name: string, source: string, regex: string, flags: string,"
    " labels: array<string>, strength: string, scope: string, origin: string, createdAt: bigint>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, dealt to all of them; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One block for each line."""
    return df.select(F.col(key).cast("string").alias("doc_key"), F.posexplode(F.split(text, "\n")).alias("block_id", "text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each turn."""
    key = F.concat_ws(":", "conv_id", "turn")
    return spread(table(spark, sf_dir, "conversations").select(key.alias("doc_key"), F.lit(0).alias("block_id"), "text"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Site records from JSON lines, by a fixed schema; only version 1 stays."""
    return spark.read.schema(RECORD).json(path).where("v = 1")
