"""The lost-and-found state machine: each transition, the batch twin, and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from veil.plans.incremental import HOURS, anchors
from veil.streaming import lost
from veil.streaming.lost import Budget, Machine

SF = "/root/testdata/sf0.001"
KINDS = ["load", "found", "gone", "changed"]


def moves(events, until=10**9, budget=Budget()):
    machine, out = Machine(budget), []
    for ms, kind in events:
        out += machine.event(ms, kind)
    return [*out, *machine.pass_to(until, True)]


@pytest.mark.parametrize(
    "events, want",
    [
        ([(0, "changed")], [(30_000, "lost")]),  # nothing found in 30 s
        ([(0, "load")], [(5_000, "lost")]),  # 5 s once the page has loaded
        ([(0, "gone"), (20_000, "load")], [(25_000, "lost")]),
        ([(0, "gone"), (28_000, "load")], [(30_000, "lost")]),  # not later than 30 s
        ([(0, "gone"), (29_999, "found")], []),
        ([(0, "found"), (100_000, "gone")], [(105_000, "lost")]),  # the grace
        ([(0, "found"), (100_000, "gone"), (104_000, "found")], []),
        ([(0, "found"), (100_000, "gone"), (103_000, "gone")], [(105_000, "lost")]),  # went once
        ([(0, "found"), (1_000, "load"), (3_000, "gone")], [(6_000, "lost")]),  # the load takes from the grace
        ([(0, "load"), (9_000, "found")], [(5_000, "lost"), (9_000, "found")]),  # found drops
        ([(0, "load"), (5_500, "changed"), (6_000, "changed"), (6_900, "changed")], [(5_000, "lost"), (7_000, "retry")]),  # at most every 2 s
        ([(0, "load"), (7_000, "changed"), (7_100, "changed"), (30_000, "changed")], [(5_000, "lost"), (7_000, "retry"), (9_000, "retry"), (31_000, "retry")]),
        ([(0, "load"), (5_500, "changed"), (6_500, "found"), (9_000, "changed")], [(5_000, "lost"), (6_500, "found")]),  # found before the timer
        ([(0, "load"), (6_000, "found"), (8_000, "gone"), (14_000, "found")], [(5_000, "lost"), (6_000, "found"), (13_000, "lost"), (14_000, "found")]),
    ],
)
def test_each_transition(events, want):
    assert moves(events) == want


def events_of(spark, rows):
    return spark.createDataFrame(rows, "sticker long, ms long, seq long, kind string").select("sticker", F.timestamp_millis("ms").alias("ts"), "seq", "kind")


def test_batch_twin(spark):
    rng = random.Random(3)
    rows, want = [], []
    for sticker in range(150):
        times = sorted(rng.randrange(0, 120) * 500 for _ in range(rng.randint(1, 25)))
        own = [(t, rng.choice(KINDS)) for t in times]
        rows += [(sticker, t, i, k) for i, (t, k) in enumerate(own)]
        want += [(sticker, *m) for m in moves(own)]
    got = [tuple(r) for r in lost.transitions(events_of(spark, rows)).select("sticker", F.unix_millis("ts"), "state").collect()]
    assert sorted(got) == sorted(want)
    running = {r.sticker for r in lost.backstops(lost.transitions(events_of(spark, rows))).collect()}
    assert running == {s for s in range(150) if [m[2] for m in want if m[0] == s][-1:] not in ([], ["found"])}


def test_stream(spark, tmp_path):
    """Batch by batch, with timers that fire between events; a last event far away lets all of them fire."""
    key, store = lost.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        given = anchors(spark, SF).orderBy("ts").collect()
        step = -(-len(given) // 4)
        for i in range(4):
            spark.createDataFrame(given[i * step : (i + 1) * step], anchors(spark, SF).schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        far = spark.createDataFrame([(-1, 4 * 10**12, 0, "found")], "sticker long, ms long, seq long, kind string").select("sticker", F.timestamp_millis("ms").alias("ts"), "seq", "kind")
        far.write.parquet(f"{tmp_path}/in/4")
        stream = spark.readStream.schema(anchors(spark, SF).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = lost.stream_transitions(stream, HOURS).writeStream.format("memory").queryName("moves").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = sorted(tuple(r) for r in spark.table("moves").collect())
    finally:
        spark.conf.set(key, before)
    want = sorted(tuple(r) for r in lost.transitions(anchors(spark, SF), HOURS).collect())
    assert got == want and {r[2] for r in want} == {"lost", "retry", "found"}
