"""What the training-data operators share: keys, intermediate tables, Arrow views of text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters, in Spark's and DuckDB's regex dialects alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six as bytes, for table look-ups.
SPACES = b" \t\n\x0b\x0c\r"


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, dealt to all of them; a large one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir; it is removed when the application ends.

    Where the setting is missing, a local master (as in tests) gets a folder of its own; a cluster is refused,
    as its executors could not read one another's folders.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veil-")
        context.setCheckpointDir(found)
    folder = f"{found}/veil-{context.applicationId}"
    if folder not in _REMOVED_AT_EXIT:
        _REMOVED_AT_EXIT.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


_REMOVED_AT_EXIT: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back, so that nothing before it is run again."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_of(key: Column, firsts: Column, n: int) -> Column:
    """The number of the last of ``n`` sorted firsts that is not above the key, by binary search."""
    steps = [1 << k for k in range((n - 1).bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(firsts, at + s) <= key, at + s).otherwise(at))


def join_copies(rows: DataFrame, groups: DataFrame, on: list[str], times: str) -> DataFrame:
    """rows joined with their group: ``groups`` has one row for each key that occurs, and how many rows have it.

    Groups of more than a partition's share of all rows are at most as many as there are partitions. They are
    broadcast, so that no task gets all rows of one; the others are joined by a shuffle.
    """
    n = parts(rows.sparkSession)
    share = max(1, (groups.agg(F.sum(times)).first()[0] or 0) // n)
    hot = F.broadcast(groups.where(F.col(times) > share))
    rest = rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(times) <= share), on)
    return rows.join(hot, on).unionByName(rest)


#: Rows of one Arrow batch; texts are long, and a worker keeps the memory of its largest batch.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in small batches, which bounds the memory of executors and workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """(key, doc_id, text, *extra): key is a unique long that sorts as (doc_id, text).

    Where every doc_id is there and no two are equal, the key is the doc_id.  Otherwise rows are
    ordered by doc_id (nulls first), text and the other columns and numbered in that order, so that rows that
    share an id are separate documents and the order is the same in every run.  Null texts become empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("key"), "doc_id", "text", *extra)
    ties = [F.to_json(F.struct(c)) for c in extra]
    return cut(docs.orderBy("doc_id", "text", *ties).withColumn("key", F.monotonically_increasing_id())).select("key", "doc_id", "text", *extra)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """keyed(docs) with all columns of docs, whatever their names, in the struct ``row``."""
    return keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "row")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a binary or string column without copying each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def slabs(starts: np.ndarray, ends: np.ndarray, most: int, overlap: int):
    """Cut documents laid end to end into slabs of about ``most`` symbols for vector work.

    Yields lists of (document, from, to): whole short documents together, long ones in pieces that
    overlap by ``overlap`` symbols, so that each window starts in exactly one piece.
    """
    slab, size = [], 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while True:
            to = min(b, a + most + overlap)
            slab.append((i, a, to))
            size += to - a
            if size >= most:
                yield slab
                slab, size = [], 0
            if to == b:
                break
            a = to - overlap
    if slab:
        yield slab


def ranges_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at every place that some range [start, end) covers."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


