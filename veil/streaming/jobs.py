"""The incremental jobs. Each takes a streaming or a batch DataFrame; stateful ones have a batch twin."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import label_kinds
from ..operators.audit import valid_audit
from ..operators.detectors import BUILTIN, HIGH_IDS, Detector
from ..operators.redact import is_bullets, redact_detected

BATCH = "750 milliseconds"
DIRTY_MOST = 2000
LOST_AFTER, GRACE = 30.0, 5.0
LATE = "10 minutes"


def redact_changes(changes: DataFrame, user: Iterable[Detector] = ()) -> DataFrame:
    """changes (…, text) with ``redacted``: checked before release, row by row, so a stream needs no state.

    High detectors always; all built-ins where the text has a label word; users' on every block; text that is
    bullets already goes through.
    """
    high = [d for d in BUILTIN if d.id in HIGH_IDS]
    done = is_bullets(F.col("text"))
    first = redact_detected(changes, "aggressive", "ranges", [*high, *user]).withColumnRenamed("redacted", "by_high").drop("n_hits")
    both = redact_detected(first, "aggressive", "ranges", [*BUILTIN, *user]).drop("n_hits")
    labelled = F.size(label_kinds(F.col("text"))) > 0
    return both.withColumn("redacted", F.when(done, F.col("text")).when(labelled, F.col("redacted")).otherwise(F.col("by_high"))).drop("by_high")


def rescans(changes: DataFrame, late: str = LATE, batch: str = BATCH) -> DataFrame:
    """changes (ts, page_id, block_id, seq, text) to the latest text of each changed block per batch of time."""
    marked = changes.withWatermark("ts", late) if changes.isStreaming else changes
    grouped = marked.groupBy(F.window("ts", batch).alias("w"), "page_id", "block_id")
    return grouped.agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.count("*").alias("changes")).select(F.col("w.start").alias("start"), "page_id", "block_id", "text", "changes")


def overflows(changes: DataFrame, late: str = LATE, batch: str = BATCH, most: int = DIRTY_MOST) -> DataFrame:
    """Pages with more than ``most`` changed blocks in a batch: they are rescanned whole. A stream counts approximately."""
    marked = changes.withWatermark("ts", late) if changes.isStreaming else changes
    n = F.approx_count_distinct("block_id", 0.01) if changes.isStreaming else F.countDistinct("block_id")
    counted = marked.groupBy(F.window("ts", batch).alias("w"), "page_id").agg(n.alias("dirty"))
    return counted.select(F.col("w.start").alias("start"), "page_id", "dirty", (F.col("dirty") > most).alias("whole_page"))


def lock_reason(debugger: Column, webdriver: Column, manual: Column) -> Column:
    return F.when(debugger, "debugger").when(webdriver, "webdriver").when(manual, "manual")


def lock_states(signals: DataFrame) -> DataFrame:
    """signals (tab, ts, seq, debugger, webdriver, manual; null: not said) to the lock after each signal."""
    upto = Window.partitionBy("tab").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(False)) for c in ("debugger", "webdriver", "manual")]
    reason = lock_reason(*last)
    return signals.select("tab", "ts", "seq", reason.isNotNull().alias("locked"), reason.alias("reason"))


_LOCK = "tab long, ts timestamp, seq long, locked boolean, reason string"


def _lock_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else [False, False, False]
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
    out = []
    for r in rows.itertuples():
        for i, said in enumerate((r.debugger, r.webdriver, r.manual)):
            if said is not None and not pd.isna(said):
                held[i] = bool(said)
        reason = next((name for name, up in zip(("debugger", "webdriver", "manual"), held, strict=True) if up), None)
        out.append((key[0], r.ts, r.seq, reason is not None, reason))
    state.update(tuple(held))
    yield pd.DataFrame(out, columns=["tab", "ts", "seq", "locked", "reason"])


def stream_lock_states(signals: DataFrame) -> DataFrame:
    """lock_states of a stream: three booleans of state for each tab."""
    return signals.groupBy("tab").applyInPandasWithState(_lock_step, _LOCK, "debugger boolean, webdriver boolean, manual boolean", "append", GroupStateTimeout.NoTimeout)


def audit_stream(log: DataFrame, late: str = LATE) -> DataFrame:
    """Valid audit rows (ts, action, origin, reason, tab); canvas pages once for each tab and origin."""
    good = valid_audit(log)
    once, rest = good.where("action = 'canvas-page'"), good.where("action <> 'canvas-page'")
    once = once.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tab", "origin"]) if log.isStreaming else once.dropDuplicates(["tab", "origin"])
    return rest.unionByName(once)


def lost_spans(events: DataFrame, after: float = LOST_AFTER, grace: float = GRACE) -> DataFrame:
    """events (sticker, ts, seq, attached) to the spans without an anchor that last longer than ``after`` seconds and the grace."""
    order = Window.partitionBy("sticker").orderBy("ts", "seq")
    spans = events.withColumn("until", F.lead("ts").over(order)).where(~F.col("attached"))
    gap = F.col("until").cast("double") - F.col("ts").cast("double")
    return spans.where(F.col("until").isNull() | (gap > after + grace)).select("sticker", F.col("ts").alias("since"), F.col("until").alias("found"))


_LOST = "sticker long, since timestamp, lost_at timestamp"


def _lost_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    limit = (LOST_AFTER + GRACE) * 1000
    lost = lambda since: pd.DataFrame([(key[0], pd.Timestamp(since, unit="ms"), pd.Timestamp(since + limit, unit="ms"))], columns=["sticker", "since", "lost_at"])
    if state.hasTimedOut:
        (since,) = state.get
        state.remove()
        yield lost(since)
        return
    since = state.get[0] if state.exists else None
    for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
        now = r.ts.timestamp() * 1000
        if since is not None and now - since > limit:
            yield lost(since)
        since = None if r.attached else int(now)
    if since is None:
        if state.exists:
            state.remove()
        return
    state.update((since,))
    if since + limit > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(int(since + limit))


def stream_lost(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """lost_spans of a stream: a timer in event time tells that nothing was found."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy("sticker").applyInPandasWithState(_lost_step, _LOST, "since long", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(batch: DataFrame, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch, for foreachBatch: late ones go to a table of their own."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return batch.where(ms >= watermark_ms), batch.where(ms < watermark_ms)
