"""Tables that jobs and micro-batches change: a change rewrites only the buckets of its keys, once for each version.

Layout: rows/v=<version>/bucket=<n>/ and commits/v=<version>/. A change writes the new rows of the buckets that it touches and then
its commit, which lists them; readers take each bucket from the latest commit that has it. Until the commit is there nothing
of a version is seen; a version that is committed is not written again, and one that was begun and not committed starts
anew from the versions before it. So a micro-batch that is replayed, with its number as the version, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import newest, upsert

BUCKETS = 64
COMMITS = "version long, bucket int, seen long"


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, keys, schema, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, version: int) -> str:
        return f"{self.path}/rows/v={version}"

    def committed(self, version: int) -> bool:
        return self._exists(f"{self.path}/commits/v={version}/_SUCCESS")

    def commits(self, before: int | None = None) -> DataFrame:
        """(version, bucket, seen) of committed versions, of those before one."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMITS)
        found = self.spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(f"{self.path}/commits")
        return found if before is None else found.where(F.col("version") < before)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, some: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the latest version of each bucket, or of some buckets, before a version."""
        latest = self.commits(before).where("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version"))
        # at most one for each bucket
        places = [f"{self._rows(r['version'])}/bucket={r['bucket']}" for r in latest.collect() if some is None or r["bucket"] in some]
        there = [p for p in places if self._exists(p)]
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    def commit(self, version: int, buckets: list[int], seen: int | None = None) -> None:
        """Every version lists at least the bucket -1, which is none."""
        rows = self.spark.createDataFrame([(version, b, seen) for b in [-1, *buckets]], COMMITS)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v={version}")

    def merge(self, changes: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """combine(rows of the touched buckets, changes) becomes these buckets' rows. False if the version was there."""
        if self.committed(version):
            return False
        placed = changes.withColumn("bucket", self.bucket())
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
        rows = combine(self.read(touched, version), changes).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._rows(version))
        self.commit(version, touched)
        return True

    def vacuum(self) -> list[int]:
        """Remove the rows of versions that no bucket is read from; which they were."""
        latest = {r["version"] for r in self.commits().where("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version")).select("version").distinct().collect()}
        gone = [r["version"] for r in self.commits().select("version").distinct().collect() if r["version"] not in latest and self._exists(self._rows(r["version"]))]
        for version in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._rows(version))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return gone


def upsert_into(table: MergeTable, changes: DataFrame, version: int, order: str = "updated_at", removed: str = "removed") -> bool:
    """The latest row of each key, removed ones out; buckets without a change keep their files."""
    return table.merge(changes, version, lambda base, new: upsert(base, new, table.keys, order, removed))


def keep_newest(table: MergeTable, order: list[Column], most: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table keeps the newest ``most`` rows of each key."""

    def write(batch: DataFrame, version: int) -> None:
        batch = batch.persist()
        table.merge(batch, version, lambda base, new: newest(base.unionByName(new), table.keys, order, most))
        table.vacuum()
        batch.unpersist()

    return write


class LateTable:
    """Rows on time and late ones, of a stream: both are written by one job and seen by one commit.

    The watermark is the latest time of all batches before, less the delay, as the engine's own is; it is kept with the commits, so
    a batch that is replayed is split in the same way.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, delay_ms: int, time: str = "ts"):
        self.table = MergeTable(spark, path, [time], schema)
        self.delay, self.time = delay_ms, time

    def watermark(self, before: int | None = None) -> int | None:
        seen = self.table.commits(before).agg(F.max("seen")).first()[0]
        return None if seen is None else seen - self.delay

    def write(self, batch: DataFrame, version: int) -> None:
        """For foreachBatch."""
        if self.table.committed(version):
            return
        batch, mark = batch.persist(), self.watermark(version)
        ms = F.unix_millis(F.col(self.time).cast("timestamp"))
        late = F.lit(False) if mark is None else F.coalesce(ms < mark, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(self.table._rows(version))
        self.table.commit(version, [], batch.agg(F.max(ms)).first()[0])
        batch.unpersist()

    def read(self, late: bool) -> DataFrame:
        found = [r["version"] for r in self.table.commits().select("version").distinct().collect()]
        places = [p for v in found if self.table._exists(p := f"{self.table._rows(v)}/late={str(late).lower()}")]
        spark = self.table.spark
        return spark.read.schema(self.table.schema).parquet(*places) if places else spark.createDataFrame([], self.table.schema)


def late_in_batches(rows: DataFrame, batch: str, delay_ms: int, time: str = "ts") -> DataFrame:
    """rows with ``late``: the batch twin, where each row says in which batch it came."""
    from pyspark.sql import Window

    ms = F.unix_millis(F.col(time).cast("timestamp"))
    # one row for each batch
    marks = rows.groupBy(batch).agg(F.max(ms).alias("seen"))
    marks = marks.select(batch, (F.max("seen").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)) - delay_ms).alias("mark"))
    return rows.join(marks, batch).withColumn("late", F.coalesce(ms < F.col("mark"), F.lit(False))).drop("mark")
