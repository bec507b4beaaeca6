"""Anchors that are lost and found: a state machine with timers in event time, and its batch twin.

Events are (sticker, ts, seq, kind); kind is 'load' (its page has loaded), 'found' (its anchor is there), 'gone' (it is not) or
'changed' (other content changed). A sticker without an anchor is being looked for. From its first event on it is lost after
``lost_after`` seconds, or ``after_load`` once the page has loaded; an anchor that was there and went has only ``grace``. Being
lost starts the backstops; a change then makes them look again, at most once in ``retry`` seconds, counted from the
loss; being found drops them.

Transitions are (sticker, ts, state): 'lost' and 'retry' at the time that their timer was set for, 'found' at the event's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that the stream's timers need, a setting of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "sticker long, ms long, state string"
_STATE = "status string, since long, fresh boolean, loaded long, lost long, tick long"
NEVER = -1


@dataclass(frozen=True)
class Budget:
    """Seconds of each rule."""

    lost_after: float = 30
    after_load: float = 5
    grace: float = 5
    retry: float = 2

    def deadline(self, since: int, fresh: bool, loaded: int) -> int:
        """When a sticker that is looked for since then is lost; loaded: when its page did, or NEVER. In milliseconds."""
        soon = int(1000 * self.after_load)
        if fresh:
            late = since + int(1000 * self.lost_after)
            return late if loaded == NEVER else min(late, max(loaded, since) + soon)
        late = since + int(1000 * self.grace)
        # the load may take away from the grace, as it does from the whole time
        return min(late, loaded + soon) if loaded != NEVER and loaded + soon > since else late


class Machine:
    """One sticker: what it is doing, and what that gives when time passes or an event comes."""

    def __init__(self, budget: Budget, held: tuple | None = None):
        self.budget = budget
        self.status, self.since, self.fresh, self.loaded, self.lost, self.tick = held or ("new", NEVER, True, NEVER, NEVER, NEVER)

    def held(self) -> tuple:
        return self.status, self.since, self.fresh, self.loaded, self.lost, self.tick

    def timer(self) -> int:
        """When something happens without any event, or NEVER."""
        return self.budget.deadline(self.since, self.fresh, self.loaded) if self.status == "looking" else self.tick

    def pass_to(self, now: int, included: bool) -> Iterator[tuple[int, str]]:
        """Timers up to now."""
        due = self.timer()
        while due != NEVER and (due < now or included and due == now):
            if self.status == "looking":
                self.status, self.lost = "lost", due
                yield due, "lost"
            else:
                self.tick = NEVER
                yield due, "retry"
            due = self.timer()

    def event(self, now: int, kind: str) -> Iterator[tuple[int, str]]:
        yield from self.pass_to(now, False)
        if self.status == "new":
            self.status, self.since = "looking", now
        if kind == "load" and self.loaded == NEVER:
            self.loaded = now
        elif kind == "found":
            if self.status == "lost":
                yield now, "found"
            self.status, self.tick = "there", NEVER
        elif kind == "gone" and self.status == "there":
            self.status, self.since, self.fresh = "looking", now, False
        elif kind == "changed" and self.status == "lost" and self.tick == NEVER and now > self.lost:
            step = int(1000 * self.budget.retry)
            self.tick = self.lost + -(-(now - self.lost) // step) * step
            yield from self.pass_to(now, True)


class _Processor(StatefulProcessor):
    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sticker", _STATE)

    def _machine(self) -> Machine:
        return Machine(self.budget, tuple(self.state.get()) if self.state.exists() else None)

    def _end(self, key: tuple, machine: Machine, out: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        self.state.update(machine.held())
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if machine.timer() != NEVER:
            self.handle.registerTimer(machine.timer())
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["sticker", "ms", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, out = self._machine(), []
        given = pd.concat(list(rows)).sort_values(["ms", "seq"])
        for ms, kind in zip(given["ms"].tolist(), given["kind"].tolist(), strict=True):
            out += machine.event(ms, kind)
        yield from self._end(key, machine, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine()
        yield from self._end(key, machine, list(machine.pass_to(expiredTimerInfo.getExpiryTimeInMs(), True)))

    def close(self) -> None:
        pass


def stream_transitions(events: DataFrame, budget: Budget = Budget(), late: str = "0 seconds") -> DataFrame:
    """Transitions of a stream of events: a value of state for each sticker, with the timer that comes next. The session has STORE."""
    ready = events.withWatermark("ts", late).select("sticker", F.unix_millis(F.col("ts")).alias("ms"), "seq", "kind", "ts")
    out = ready.groupBy("sticker").transformWithStateInPandas(_Processor(budget), _OUT, "Append", "EventTime")
    return out.select("sticker", F.timestamp_millis("ms").alias("ts"), "state")


def transitions(events: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Transitions of a table of events: the batch twin, in windows over each sticker."""
    ms = lambda s: F.lit(int(1000 * s))
    order = Window.partitionBy("sticker").orderBy("ms", "seq")
    whole, upto, after = Window.partitionBy("sticker"), order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = events.select("sticker", F.unix_millis(F.col("ts")).alias("ms"), "seq", "kind")
    anchored = F.when(F.col("kind").isin("found", "gone"), F.col("kind"))
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("n"),
        F.min(F.when(F.col("kind") == "load", F.col("ms"))).over(whole).alias("loaded"),
        F.last(anchored, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min(F.when(F.col("kind") == "found", F.col("ms"))).over(after).alias("until"),
    )
    fresh, went = (F.col("n") == 1) & (F.col("kind") != "found"), (F.col("kind") == "gone") & (F.col("before") == "found")
    late = F.col("ms") + ms(budget.lost_after)
    first = F.least(late, F.greatest("loaded", "ms") + ms(budget.after_load))
    soon = F.col("loaded") + ms(budget.after_load)
    again = F.col("ms") + ms(budget.grace)
    again = F.when(soon > F.col("ms"), F.least(again, soon)).otherwise(again)
    lost_at = F.when(fresh, F.when(F.col("loaded").isNull(), late).otherwise(first)).when(F.coalesce(went, F.lit(False)), again)
    span = F.when(lost_at.isNotNull(), F.struct(lost_at.alias("lost"), "until"))
    # each row with the last search that began
    rows = rows.withColumn("starts", lost_at.isNotNull()).withColumn("span", F.last(span, ignorenulls=True).over(upto)).where("span is not null")
    rows = rows.select("sticker", "ms", "kind", "starts", "span.lost", "span.until")
    before = lambda c: F.col("until").isNull() | (c < F.col("until"))
    lost = rows.where(F.col("starts") & before(F.col("lost")))
    tick = F.col("lost") + F.ceil((F.col("ms") - F.col("lost")) / ms(budget.retry)) * ms(budget.retry)
    looked = rows.where((F.col("kind") == "changed") & (F.col("ms") > F.col("lost"))).withColumn("tick", tick.cast("long"))
    looked = looked.where(before(F.col("ms")) & before(F.col("tick"))).select("sticker", F.col("tick").alias("ms"), F.lit("retry").alias("state")).distinct()
    out = lost.select("sticker", F.col("lost").alias("ms"), F.lit("lost").alias("state"))
    out = out.unionByName(looked).unionByName(lost.where("until is not null").select("sticker", F.col("until").alias("ms"), F.lit("found").alias("state")))
    return out.select("sticker", F.timestamp_millis("ms").alias("ts"), "state")


def backstops(moves: DataFrame) -> DataFrame:
    """(sticker, since): stickers whose backstops are to run after these transitions, as the last of them is not 'found'."""
    rank = F.when(F.col("state") == "found", 2).when(F.col("state") == "retry", 1).otherwise(0)
    last = moves.groupBy("sticker").agg(F.max(F.struct("ts", rank.alias("rank"))).alias("last"), F.max(F.when(F.col("state") == "lost", F.col("ts"))).alias("since"))
    return last.where("last.rank < 2").select("sticker", "since")
