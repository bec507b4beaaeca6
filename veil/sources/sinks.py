"""Writers. Nothing is stored that looks like an identifier: every write goes through the leak guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.audit import guarded, leak_audit, valid_audit

DISMISSED_MOST = 500


def guarded_write(df: DataFrame, id_column: str, path: str, by: list[str] | None = None) -> DataFrame:
    """Write the rows that leak nothing; the ids of the others are returned."""
    stored, dropped = guarded(df, id_column)
    writer = stored.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return dropped


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits as identities (doc_key, id, pattern, name, score, place, total): matched text has no column to go to."""
    hits.select("doc_key", "id", "pattern", "name", "score", "place", "total").write.mode("append").partitionBy("pattern").parquet(path)


def write_redacted(texts: DataFrame, path: str) -> None:
    """Redacted texts only; the column with the originals is not written."""
    texts.select("doc_key", "block_id", "redacted", "n_hits").write.mode("append").parquet(path)


def write_audit(log: DataFrame, path: str) -> None:
    valid_audit(log).select("ts", "action", "origin", "reason").write.mode("append").partitionBy("action").parquet(path)


def clean_dismissed(rows: DataFrame, most: int = DISMISSED_MOST) -> DataFrame:
    """Dismissed suggestions (origin, id, place) that are keyed hashes, the newest of each origin."""
    newest = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("place")))
    return rows.where(F.col("id").rlike(r"^[0-9a-f]{64}\z")).withColumn("n", newest).where(F.col("n") <= most).drop("n")


def assert_clean(df: DataFrame, id_column: str) -> None:
    """Fail if any field of any row looks like an identifier."""
    found = leak_audit(df, id_column).select("path", "pattern").take(1)
    if found:
        raise ValueError(f"field {found[0]['path']} looks like: {found[0]['pattern']}")
