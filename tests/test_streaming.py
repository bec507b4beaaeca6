"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from veil.plans.incremental import changes, signals
from veil.streaming import jobs

SF = "/root/testdata/sf0.001"


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


class _Streamed:
    """Stands for a session whose tables are read as streams."""

    class read:
        session = None

        @classmethod
        def parquet(cls, path):
            folder, _, name = path.rpartition("/")
            schema = cls.session.read.parquet(path).schema
            return cls.session.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def test_redact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stream = spark.readStream.schema("doc_id long, text string").option("pathGlobFilter", "documents.parquet").parquet(SF)
    _run(jobs.redact_changes(stream).select("doc_id", "redacted"), "redacted")
    assert spark.table("redacted").exceptAll(jobs.redact_changes(docs).select("doc_id", "redacted")).isEmpty() and spark.table("redacted").count() == docs.count()


def test_locks(spark):
    _Streamed.read.session = spark
    _run(jobs.stream_lock_states(signals(_Streamed, SF)), "locks")
    batch = jobs.lock_states(signals(spark, SF))
    assert spark.table("locks").select("tab", "seq", "locked", "reason").exceptAll(batch.select("tab", "seq", "locked", "reason")).isEmpty()
    assert spark.table("locks").count() == batch.count()


def test_rescans_and_lost(spark):
    _Streamed.read.session = spark
    _run(jobs.rescans(changes(_Streamed, SF), batch="6 hours"), "rescans")
    batch = jobs.rescans(changes(spark, SF), batch="6 hours")
    closed = spark.table("rescans")
    # the watermark keeps the last windows open
    assert closed.exceptAll(batch).isEmpty() and closed.count() > 0.8 * batch.count()
    as_events = lambda c: c.select(F.col("page_id").alias("sticker"), "ts", "seq", (F.col("event_type") != "error").alias("attached"))
    _run(jobs.stream_lost(as_events(changes(_Streamed, SF))), "lost")
    lost = jobs.lost_spans(as_events(changes(spark, SF)))
    got = spark.table("lost").select("sticker", F.date_trunc("second", "since").alias("since")).distinct()
    want = lost.select("sticker", F.date_trunc("second", "since").alias("since")).distinct()
    assert got.subtract(want).isEmpty() and got.count() >= 0.9 * want.count()
