"""Queries of the incremental jobs, run as batches over all events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.windows import newest
from ..sources import merged, readers
from ..sources.readers import table
from ..sources.store import shared_dir
from ..streaming import jobs, lost, retract
from .detection import REDACTED
from .registry import query
from .reports import AUDIT, audit_log
from .texts import LINES


def changes(spark, sf_dir):
    """Events as changes of blocks: users are pages, twenty blocks each."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("page_id"), (F.col("event_id") % 20).alias("block_id"), F.col("event_id").alias("seq"), "event_type", F.col("props").alias("text"))


def signals(spark, sf_dir):
    """Events as signals of tabs."""
    up = lambda on, off: F.when(F.col("event_type") == on, True).when(F.col("event_type") == off, False)
    return changes(spark, sf_dir).select(F.col("page_id").alias("tab"), "ts", "seq", up("click", "view").alias("debugger"), up("error", "purchase").alias("webdriver"), up("signup", "purchase").alias("manual"))


_CHANGES = "(SELECT ts, user_id AS page_id, event_id % 20 AS block_id, event_id AS seq, event_type, props AS text FROM events)"


@query("e01_stream_redact", f"SELECT doc_key, block_id, {REDACTED} AS redacted FROM {LINES}")
def e01_stream_redact(spark, sf_dir):
    return jobs.redact_changes(readers.read_documents(spark, sf_dir)).select("doc_key", "block_id", "redacted")


@query("e02_stream_rescan", f"SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, page_id, block_id, arg_max(text, seq) AS text, count(*) AS changes FROM {_CHANGES} GROUP BY ALL".replace("arg_max(text, seq)", "last(text ORDER BY ts, seq)"))
def e02_stream_rescan(spark, sf_dir):
    return jobs.rescans(changes(spark, sf_dir), batch="6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("e03_dirty_overflow", f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, page_id, count(DISTINCT block_id) AS dirty, count(DISTINCT block_id) > 5 AS whole_page FROM {_CHANGES} GROUP BY ALL")
def e03_dirty_overflow(spark, sf_dir):
    return jobs.overflows(changes(spark, sf_dir), batch="1 day", most=5).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "e04_lock_state",
    f"""WITH s AS (SELECT page_id AS tab, ts, seq, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS d, CASE event_type WHEN 'error' THEN true WHEN 'purchase' THEN false END AS w, CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS m FROM {_CHANGES}),
    l AS (SELECT tab, seq, last_value(d IGNORE NULLS) OVER o AS d, last_value(w IGNORE NULLS) OVER o AS w, last_value(m IGNORE NULLS) OVER o AS m FROM s WINDOW o AS (PARTITION BY tab ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
    SELECT tab, seq, coalesce(d, false) OR coalesce(w, false) OR coalesce(m, false) AS locked, CASE WHEN d THEN 'debugger' WHEN w THEN 'webdriver' WHEN m THEN 'manual' END AS reason FROM l""",
)
def e04_lock_state(spark, sf_dir):
    return jobs.lock_states(signals(spark, sf_dir)).select("tab", "seq", "locked", "reason")


@query("e05_audit_log", f"SELECT user_id, event_id, action FROM {AUDIT} WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def e05_audit_log(spark, sf_dir):
    log = audit_log(spark, sf_dir).withColumn("origin", F.lit("origin")).withColumn("reason", F.lit(None).cast("string")).withColumn("tab", F.col("user_id"))
    return newest(jobs.audit_stream(log), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id", "action")


@query("e06_lost_state", f"SELECT sticker, seq FROM (SELECT page_id AS sticker, seq, ts, event_type, lead(ts) OVER (PARTITION BY page_id ORDER BY ts, seq) AS until FROM {_CHANGES}) WHERE event_type = 'error' AND (until IS NULL OR epoch_us(until) - epoch_us(ts) > 35000000)")
def e06_lost_state(spark, sf_dir):
    events = changes(spark, sf_dir).select(F.col("page_id").alias("sticker"), "ts", "seq", (F.col("event_type") != "error").alias("attached"))
    lost = jobs.lost_spans(events)
    return lost.join(events.where("not attached"), (lost["sticker"] == events["sticker"]) & (lost["since"] == events["ts"])).select(lost["sticker"], "seq")


#: The rules' seconds as hours, as the events are hours apart.
HOURS = lost.Budget(30 * 3600, 5 * 3600, 5 * 3600, 2 * 3600)


def anchors(spark, sf_dir):
    """Events as those of stickers' anchors."""
    kind = F.when(F.col("event_type") == "error", "gone").when(F.col("event_type") == "purchase", "found").when(F.col("event_type") == "signup", "load").otherwise("changed")
    return changes(spark, sf_dir).select(F.col("page_id").alias("sticker"), "ts", "seq", kind.alias("kind"))


_MOVES = f"""
  WITH e AS (SELECT page_id AS sticker, epoch_us(ts) // 1000 AS ms, seq, CASE event_type WHEN 'error' THEN 'gone' WHEN 'purchase' THEN 'found' WHEN 'signup' THEN 'load' ELSE 'changed' END AS kind FROM {_CHANGES}),
  w AS (SELECT *, row_number() OVER o AS n, min(CASE WHEN kind = 'load' THEN ms END) OVER (PARTITION BY sticker) AS loaded,
      last_value(CASE WHEN kind IN ('found', 'gone') THEN kind END IGNORE NULLS) OVER (PARTITION BY sticker ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      min(CASE WHEN kind = 'found' THEN ms END) OVER (PARTITION BY sticker ORDER BY ms, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until
    FROM e WINDOW o AS (PARTITION BY sticker ORDER BY ms, seq)),
  s AS (SELECT *, CASE WHEN n = 1 AND kind <> 'found' THEN least(ms + 108000000, CASE WHEN loaded IS NOT NULL THEN greatest(loaded, ms) + 18000000 END)
      WHEN kind = 'gone' AND before = 'found' THEN CASE WHEN loaded + 18000000 > ms THEN least(ms, loaded) + 18000000 ELSE ms + 18000000 END END AS lost FROM w),
  p AS (SELECT *, lost IS NOT NULL AS starts, last_value(lost IGNORE NULLS) OVER u AS began, last_value(CASE WHEN lost IS NOT NULL THEN coalesce(until, 9223372036854775807) END IGNORE NULLS) OVER u AS stop
    FROM s WINDOW u AS (PARTITION BY sticker ORDER BY ms, seq ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT DISTINCT sticker, began + ((ms - began + 7199999) // 7200000) * 7200000 AS ms, stop FROM p WHERE kind = 'changed' AND ms > began AND ms < stop),
  m AS (SELECT sticker, began AS ms, 'lost' AS state FROM p WHERE starts AND began < stop
    UNION ALL SELECT sticker, ms, 'retry' FROM k WHERE ms < stop
    UNION ALL SELECT sticker, stop, 'found' FROM p WHERE starts AND began < stop AND stop < 9223372036854775807)
"""


@query("e06_transitions", f"{_MOVES} SELECT sticker, ms, state FROM m")
def e06_transitions(spark, sf_dir):
    return lost.transitions(anchors(spark, sf_dir), HOURS).select("sticker", F.unix_millis("ts").alias("ms"), "state")


@query("e06_backstops", f"{_MOVES} SELECT sticker, max(CASE WHEN state = 'lost' THEN ms END) AS since FROM m GROUP BY sticker HAVING max(ms * 4 + CASE state WHEN 'found' THEN 2 WHEN 'retry' THEN 1 ELSE 0 END) % 4 < 2")
def e06_backstops(spark, sf_dir):
    return lost.backstops(lost.transitions(anchors(spark, sf_dir), HOURS)).select("sticker", F.unix_millis("since").alias("since"))


@query("e05_audit_table", f"SELECT user_id, event_id, action, ts FROM {AUDIT} WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200")
def e05_audit_table(spark, sf_dir):
    """The newest 200 of each user, from a table that three batches of all events are merged into; the second comes twice."""
    log = audit_log(spark, sf_dir).where("action is not null").select("user_id", "event_id", "action", "ts")
    target = merged.MergeTable(spark, f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}", ["user_id"], log.schema, 8)
    write = merged.keep_newest(target, [F.desc("ts"), F.desc("event_id")], 200)
    for version in (0, 1, 1, 2):
        write(log.where(F.col("event_id") % 3 == version), version)
    return target.read()


@query(
    "e07_late_by_batch",
    """WITH e AS (SELECT event_id, event_id // 1000 AS batch, epoch_us(ts) // 1000 AS ms FROM events), b AS (SELECT batch, max(ms) AS seen FROM e GROUP BY batch),
    m AS (SELECT batch, max(seen) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 864000000 AS mark FROM b) SELECT event_id, coalesce(ms < mark, false) AS late FROM e JOIN m USING (batch)""",
)
def e07_late_by_batch(spark, sf_dir):
    """All events as they would come in batches of 1,000 ids, with ten days of delay."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.floor(F.col("event_id") / 1000).alias("batch"))
    return merged.late_in_batches(rows, "batch", 864_000_000).select("event_id", "late")


def rescans(spark, sf_dir):
    """Events as changes of five blocks a user, with no, one or two numbers; some are removed or covered."""
    op = F.when(F.col("event_type") == "view", "removed").when(F.col("event_type") == "error", "covered").otherwise("changed")
    one = F.concat(F.lit("SSN 123-45-"), (1000 + F.col("event_id") % 9000).cast("string"))
    text = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, "nothing to see").otherwise(F.concat(one, F.lit(" or SSN 219-46-7777")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), (F.col("event_id") % 5).alias("block_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), text.alias("text"))


_RESCANS = """
  WITH e AS (SELECT user_id AS page_id, event_id % 5 AS block_id, ts, event_id AS seq,
      CASE WHEN event_type IN ('view', 'error') OR event_id % 3 = 1 THEN [] WHEN event_id % 3 = 0 THEN [4] ELSE [4, 23] END AS found FROM events),
  w AS (SELECT *, coalesce(lag(found) OVER (PARTITION BY page_id, block_id ORDER BY ts, seq), []) AS before FROM e),
  m AS (SELECT page_id, block_id, ts, seq, 'add' AS move, unnest(list_filter(found, lambda x: NOT list_contains(before, x))) AS start FROM w
    UNION ALL SELECT page_id, block_id, ts, seq, 'drop', unnest(list_filter(before, lambda x: NOT list_contains(found, x))) FROM w)
"""


@query("e02_rescan_moves", f"{_RESCANS} SELECT page_id, block_id, seq, move, 'ssn' AS pattern, start::INT AS start, (start + 11)::INT AS \"end\" FROM m")
def e02_rescan_moves(spark, sf_dir):
    return retract.rescan_moves(rescans(spark, sf_dir)).drop("ts")


@query("e02_standing_hits", "SELECT page_id, block_id, 'ssn' AS pattern, start::INT AS start, (start + 11)::INT AS \"end\" FROM (SELECT page_id, block_id, unnest(found) AS start FROM (" + _RESCANS.replace("\n  m AS", "\n  m_ AS") + " SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY page_id, block_id ORDER BY ts DESC, seq DESC) = 1))")
def e02_standing_hits(spark, sf_dir):
    return retract.standing_hits(retract.rescan_moves(rescans(spark, sf_dir)))
