"""Rescans that detect and take back: each change of a block gives the hits that are new and those that are gone.

Changes are (page_id, block_id, ts, seq, op, text); op is 'changed', 'removed' or 'covered', and a block that is removed or covered has
no hits. Detection is a projection; the state of a block is what its last change gave, so a hit that stays gives nothing. A
change older than the last one of its block says nothing any more.

Moves are (page_id, block_id, ts, seq, move, pattern, start, end); move is 'add' or 'drop'.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import detect
from ..operators.detectors import BUILTIN, Detector

_FOUND = "page_id long, block_id long, us long, seq long, move string, hit string"


def _hits(changes: DataFrame, sensitivity: str, detectors: Iterable[Detector]) -> DataFrame:
    """changes with ``found``, the hits of each as sorted texts 'pattern:start:end'."""
    text = F.when(F.col("op") == "changed", F.coalesce("text", F.lit(""))).otherwise("")
    ready = changes.select("page_id", "block_id", "ts", F.unix_micros(F.col("ts")).alias("us"), "seq", text.alias("text"))
    said = F.transform("hits", lambda h: F.concat_ws(":", h["pattern"], h["start"].cast("string"), h["end"].cast("string")))
    return detect(ready, sensitivity, detectors, "all").withColumn("found", F.array_sort(F.array_distinct(said))).drop("hits", "text")


def _told(moves: DataFrame) -> DataFrame:
    # a detector's name may hold a colon, the places are the last two
    parts: Column = F.split("hit", ":")
    n = F.size(parts)
    return moves.select(
        "page_id", "block_id", F.timestamp_micros("us").alias("ts"), "seq", "move",
        F.array_join(F.slice(parts, F.lit(1), n - 2), ":").alias("pattern"), F.get(parts, n - 2).cast("int").alias("start"), F.get(parts, n - 1).cast("int").alias("end"),
    )


def rescan_moves(changes: DataFrame, sensitivity: str = "balanced", detectors: Iterable[Detector] = BUILTIN) -> DataFrame:
    """Moves of a table of changes: the batch twin."""
    order = Window.partitionBy("page_id", "block_id").orderBy("us", "seq")
    none = F.array().cast("array<string>")
    rows = _hits(changes, sensitivity, detectors).withColumn("before", F.coalesce(F.lag("found").over(order), none))
    both = lambda move, hits: F.transform(hits, lambda h: F.struct(F.lit(move).alias("move"), h.alias("hit")))
    moved = F.concat(both("drop", F.array_except("before", "found")), both("add", F.array_except("found", "before")))
    return _told(rows.select("page_id", "block_id", "us", "seq", F.explode(moved).alias("m")).select("page_id", "block_id", "us", "seq", "m.move", "m.hit"))


class _Retract(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", "us long, seq long, hits string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, seq, hits = self.state.get() if self.state.exists() else (None, None, "")
        held, out = set(hits.split("\n")) - {""}, []
        given = pd.concat(list(rows)).sort_values(["us", "seq"])
        for at, number, found in zip(given["us"].tolist(), given["seq"].tolist(), given["found"].tolist(), strict=True):
            if us is not None and (at, number) <= (us, seq):
                continue
            now = set(found)
            out += [(*key, at, number, "drop", h) for h in sorted(held - now)] + [(*key, at, number, "add", h) for h in sorted(now - held)]
            us, seq, held = at, number, now
        if us is not None:
            self.state.update((us, seq, "\n".join(sorted(held))))
        yield pd.DataFrame(out, columns=["page_id", "block_id", "us", "seq", "move", "hit"])

    def close(self) -> None:
        pass


def stream_moves(changes: DataFrame, sensitivity: str = "balanced", detectors: Iterable[Detector] = BUILTIN) -> DataFrame:
    """Moves of a stream of changes. The session has lost.STORE."""
    ready = _hits(changes, sensitivity, detectors).select("page_id", "block_id", "us", "seq", "found")
    return _told(ready.groupBy("page_id", "block_id").transformWithStateInPandas(_Retract(), _FOUND, "Append", "None"))


def standing_hits(moves: DataFrame) -> DataFrame:
    """(page_id, block_id, pattern, start, end): what is left after these moves."""
    last = moves.groupBy("page_id", "block_id", "pattern", "start", "end").agg(F.max_by("move", F.struct("ts", "seq")).alias("move"))
    return last.where("move = 'add'").drop("move")
