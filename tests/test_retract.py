"""Rescans that take hits back: the stream, its batch twin, and a plain version."""

from pyspark.sql import functions as F

from veil.plans.incremental import rescans
from veil.streaming import lost, retract

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, block_id long, us long, seq long, op string, text string"
ONE, TWO = "SSN 123-45-6789", "SSN 123-45-6789 or SSN 219-46-7777"


def moves(df):
    return sorted((r.seq, r.move, r.start) for r in df.collect())


def test_each_change(spark):
    rows = [(1, 1, 10, 0, "changed", ONE), (1, 1, 20, 1, "changed", ONE), (1, 1, 30, 2, "changed", TWO), (1, 1, 40, 3, "covered", TWO), (1, 1, 50, 4, "changed", TWO), (1, 1, 60, 5, "changed", "gone"), (1, 1, 70, 6, "removed", None), (1, 2, 10, 7, "changed", None), (1, 2, 20, 8, "changed", ONE)]
    changes = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))
    found = retract.rescan_moves(changes)
    assert moves(found) == [(0, "add", 4), (2, "add", 23), (3, "drop", 4), (3, "drop", 23), (4, "add", 4), (4, "add", 23), (5, "drop", 4), (5, "drop", 23), (8, "add", 4)]
    assert [(r.block_id, r.pattern, r.start, r.end) for r in retract.standing_hits(found).collect()] == [(2, "ssn", 4, 15)]


def test_stream(spark, tmp_path):
    key, store = lost.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        given = rescans(spark, SF).orderBy("ts", "seq").collect()
        step = -(-len(given) // 3)
        for i in range(3):
            spark.createDataFrame(given[i * step : (i + 1) * step], rescans(spark, SF).schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(rescans(spark, SF).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        retract.stream_moves(stream).writeStream.format("memory").queryName("rescanned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(300)
        got = sorted(tuple(r) for r in spark.table("rescanned").collect())
    finally:
        spark.conf.set(key, before)
    want = retract.rescan_moves(rescans(spark, SF))
    assert got == sorted(tuple(r) for r in want.collect()) and {r[4] for r in got} == {"add", "drop"}
    assert sorted(map(tuple, retract.standing_hits(spark.createDataFrame(got, want.schema)).collect())) == sorted(map(tuple, retract.standing_hits(want).collect()))
