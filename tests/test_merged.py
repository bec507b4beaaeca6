"""Tables that change by bucket and by micro-batch."""

import glob
import os
import random

from pyspark.sql import functions as F

from veil.operators.windows import newest
from veil.plans.incremental import audit_log
from veil.sources import merged

SF = "/root/testdata/sf0.001"
RECORD = "id long, name string, updated_at long"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/rows/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def changes(spark, given):
    return spark.createDataFrame(given, f"{RECORD}, removed boolean")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = merged.MergeTable(spark, f"{tmp_path}/t", ["id"], RECORD, 16)
    assert table.read().isEmpty()
    assert merged.upsert_into(table, changes(spark, [(i, f"n{i}", 1, False) for i in range(200)]), 0)
    before = files(f"{tmp_path}/t")
    assert merged.upsert_into(table, changes(spark, [(7, "new", 2, False), (8, None, 2, True), (9, "old", 0, False)]), 1)
    after = files(f"{tmp_path}/t")
    assert before.items() <= after.items()  # no file was touched, and only the changed buckets have new ones
    assert 1 <= len(after) - len(before) <= 3
    want = {i: (i, f"n{i}", 1) for i in range(200)} | {7: (7, "new", 2)}
    del want[8]
    assert rows(table.read()) == sorted(want.values())
    assert not merged.upsert_into(table, changes(spark, [(1, "again", 9, False)]), 1)  # a version is written once
    assert rows(table.read()) == sorted(want.values()) and files(f"{tmp_path}/t") == after


def test_bucket_that_becomes_empty(spark, tmp_path):
    table = merged.MergeTable(spark, f"{tmp_path}/t", ["id"], RECORD, 4)
    merged.upsert_into(table, changes(spark, [(i, "x", 1, False) for i in range(20)]), 3)
    merged.upsert_into(table, changes(spark, [(i, None, 2, True) for i in range(20)]), 4)
    assert table.read().isEmpty() and table.vacuum() == [3]


def test_what_is_not_committed_is_not_seen(spark, tmp_path):
    table = merged.MergeTable(spark, f"{tmp_path}/t", ["id"], RECORD, 4)
    merged.upsert_into(table, changes(spark, [(i, "x", 1, False) for i in range(20)]), 0)
    want = rows(table.read())

    def lost(base, new):
        raise RuntimeError("the driver is lost")

    commit, table.commit = table.commit, lambda *a: lost(None, None)
    try:
        merged.upsert_into(table, changes(spark, [(1, "half", 5, False)]), 1)
    except RuntimeError:
        pass
    table.commit = commit
    assert rows(table.read()) == want
    merged.upsert_into(table, changes(spark, [(2, "whole", 5, False)]), 1)
    assert rows(table.read()) == sorted([r for r in want if r[0] != 2] + [(2, "whole", 5)])


def stream_of(spark, given, path, n):
    """The table as files that a stream reads one by one, in the order of ``n``."""
    for i in range(n):
        given.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{path}/{i}")
        for f in glob.glob(f"{path}/{i}/*.parquet"):
            os.utime(f, (10**9 + i, 10**9 + i))
    return spark.readStream.schema(given.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(stream, write, at):
    stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(300)


def test_newest_as_a_stream(spark, tmp_path):
    log = audit_log(spark, SF).where("action is not null")
    table = merged.MergeTable(spark, f"{tmp_path}/t", ["user_id"], log.schema, 8)
    order = [F.desc("ts"), F.desc("event_id")]
    write, batches = merged.keep_newest(table, order, 20), []

    def seen(batch, version):
        batches.append((version, batch.collect()))
        write(batch, version)

    run(stream_of(spark, log.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))), f"{tmp_path}/in", 4), seen, f"{tmp_path}/c")
    want = rows(newest(log, ["user_id"], order, 20))
    assert len(batches) == 4 and rows(table.read()) == want
    before = files(f"{tmp_path}/t")
    for version, batch in batches:
        write(spark.createDataFrame(batch, log.schema), version)
    assert rows(table.read()) == want and files(f"{tmp_path}/t") == before
    assert len(glob.glob(f"{tmp_path}/t/rows/v=*")) <= 2  # bounded: versions that nothing is read from go


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    rng = random.Random(5)
    given = [(i, 10**12 + 1000 * (i // 50 * 60 + rng.randint(-90, 60)), i // 50) for i in range(250)]
    df = spark.createDataFrame(given, "id long, ms long, part long").select("id", F.timestamp_millis("ms").alias("ts"), "part")
    table, batches = merged.LateTable(spark, f"{tmp_path}/t", df.drop("part").schema, 60_000), []

    def seen(batch, version):
        batches.append((version, batch.collect()))
        table.write(batch, version)

    run(stream_of(spark, df, f"{tmp_path}/in", 5), seen, f"{tmp_path}/c")
    late, top = set(), None
    for part in range(5):
        own = [g for g in given if g[2] == part]
        late |= {i for i, ms, _ in own if top is not None and ms < top - 60_000}
        top = max(ms for g in own for ms in [g[1]]) if top is None else max(top, *(g[1] for g in own))
    assert 5 < len(late) < 200
    assert sorted(r.id for r in table.read(True).collect()) == sorted(late)
    assert sorted(r.id for r in table.read(False).collect()) == sorted({g[0] for g in given} - late)  # none lost, none twice
    twin = merged.late_in_batches(df, "part", 60_000)
    assert {r.id for r in twin.where("late").collect()} == late
    for version, batch in batches:
        table.write(spark.createDataFrame(batch, df.drop("part").schema), version)
    assert table.read(True).count() == len(late) and table.read(False).count() == 250 - len(late)
