"""Operator 10: chat formatting with a prefix tree.

A turn is written ``<s>[role]text</s>``; ``< [ ] \\`` inside roles and texts get a backslash before them, so
control strings in a text are text and reading back is exact.  A turn is a tree node named by a hash of all
turns up to it, so conversations that begin alike share nodes.  Each tree is emitted depth-first, every node
once, with its place in the emitted sequence (``offset``), the position ids of its characters (``position`` on: what
stands before it in the conversation, not in the sequence) and the intervals of its ancestors in the
sequence, which with itself are all it may attend to; ancestors that stand side by side there are one interval.

The *walk* of a conversation is the string of its nodes' hashes: walks in order are the tree depth-first, and
the nodes that a conversation adds are those beyond what it shares with the one before.  Distinct
conversations are dealt to ranges of their walks, so a tree of any size, also one below a first turn that a
third of all conversations share, spreads over tasks.  A first pass over lengths gives each range's total and
the path on which it ends; their prefix sums (one row for each range) are where the ranges begin in the second pass.

Cases: null texts and roles become empty; turns that share a number are ordered by role, then text; repeated rows
are turns of their own; rows without conv_id are one conversation; equal conversations share all nodes; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, range_of, small_batches, table

_SPECIAL = re.compile(r"([\\<\[\]])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\<\[\]]|\\.)*)\]((?:[^\\<\[\]]|\\.)*)</s>", re.DOTALL)
LEARNED = "assistant"
#: Bytes of a node's hash.
NODE = 16
#: Walks sampled for each range, at least, and bytes of a walk that a bound between ranges may have.
SAMPLE, BOUND = 8, 64 * NODE

_HELD = "conv_id long, leaf binary, walk binary, lengths array<long>, turns array<struct<role: string, text: string>>"
NODES = (
    "part int, root binary, node binary, parent binary, depth int, role string, text string, offset bigint, position bigint, length bigint,"
    " loss_start bigint, loss_stop bigint, attends array<struct<start: bigint, stop: bigint>>, ends boolean"
)
_STATE = "part int, total long, inherited int, starts array<long>, stops array<long>"
_READ = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What opens a turn, what it says, and what closes it."""
    return f"<s>[{escape(role)}]", escape(text), "</s>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation with its walk and the lengths of its nodes."""
    for batch in batches:
        leaves, walks, lengths = [], [], []
        for turns in batch.column("turns").to_pylist():
            parent, walk, own = b"", [], []
            for turn in turns:
                text = "".join(formatted(turn["role"], turn["text"]))
                parent = hashlib.blake2b(parent + text.encode(), digest_size=NODE).digest()
                walk.append(parent)
                own.append(len(text))
            leaves.append(parent)
            walks.append(b"".join(walk))
            lengths.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(leaves, pa.binary()), pa.array(walks, pa.binary()), pa.array(lengths, pa.list_(pa.int64())), batch.column("turns")], ["conv_id", "leaf", "walk", "lengths", "turns"]
        )


def shared(a: bytes, b: bytes) -> int:
    """Nodes that two walks have in common from the root."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // NODE
    at = 0
    while a[at : at + NODE] == b[at : at + NODE]:
        at += NODE
    return at // NODE


def _measure(before: dict[int, bytes]):
    """Over one range's (part, walk, lengths) in order: its total length, and its part of the path at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, stack = None, b"", 0, []
        for batch in batches:
            for part_, walk, lengths in zip(*(batch.column(c).to_pylist() for c in ("part", "walk", "lengths")), strict=True):
                if part is None:
                    part, last = part_, before[part_]
                    stack = [None] * (len(last) // NODE)
                del stack[shared(last, walk) :]
                for length in lengths[len(stack) :]:
                    stack.append((at, at + length))
                    at += length
                last = walk
        if part is not None:
            own = [x for x in stack if x is not None]
            columns = [[part], [at], [len(stack) - len(own)], [[a for a, _ in own]], [[b for _, b in own]]]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "total", "inherited", "starts", "stops"])

    return run


class Path:
    """Intervals of the nodes from the root to the one at hand, and of their maximal runs."""

    def __init__(self, intervals: list[tuple[int, int]] = ()):
        self.nodes, self.runs, self.length = [], [], 0
        for a, b in intervals:
            self.push(a, b)

    def push(self, start: int, stop: int) -> None:
        self.nodes.append((start, stop))
        self.length += stop - start
        if self.runs and self.runs[-1][1] == start:
            self.runs[-1] = (self.runs[-1][0], stop)
        else:
            self.runs.append((start, stop))

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            start, stop = self.nodes.pop()
            self.length -= stop - start
            first, _ = self.runs.pop()
            if first < start:
                self.runs.append((first, start))


def _emit(states: dict[int, tuple[int, bytes, list]]):
    """Over one range's (part, walk, turns) in order: the nodes that each conversation adds.

    states: where each range begins, the walk before it, and the intervals of that walk's nodes.
    """
    names = [c.split()[0] for c in NODES.split(", ") if not c.startswith("stop")]
    interval = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, interval, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, path = None, b"", 0, Path()
        for batch in batches:
            out: list[tuple] = []
            for part_, walk, turns in zip(*(batch.column(c).to_pylist() for c in ("part", "walk", "turns")), strict=True):
                if part is None:
                    part = part_
                    at, last, held = states[part_]
                    path = Path(held)
                path.cut(shared(last, walk))
                for depth in range(len(path.nodes), len(turns)):
                    role = turns[depth]["role"]
                    head, body, close = formatted(role, turns[depth]["text"])
                    length = len(head) + len(body) + len(close)
                    first = path.nodes[0][0] if path.nodes else at  # places count from the tree's root
                    node, parent = walk[depth * NODE : (depth + 1) * NODE], walk[max(depth - 1, 0) * NODE : depth * NODE]
                    loss = (len(head), len(head) + len(body)) if role == LEARNED else (0, 0)
                    attends = [{"start": a - first, "stop": b - first} for a, b in path.runs]
                    out.append((part, walk[:NODE], node, parent, depth, role, head + body + close, at - first, path.length, length, *loss, attends, depth == len(turns) - 1))
                    path.push(at, at + length)
                    at += length
                last = walk
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def paths(conversations: DataFrame) -> DataFrame:
    """Each conversation with its last node, walk, node lengths and turns."""
    small_batches(conversations.sparkSession)
    blank = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).alias("t"),
    )
    in_order = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy("conv_id").agg(in_order.alias("turns")).mapInArrow(_paths, _HELD)


def _ranges(walks: DataFrame, n: int) -> list[str]:
    """First walks of ranges, in hexadecimal and cut to BOUND, from a sample by hash; the first range has none."""
    every = max(1, walks.count() // (SAMPLE * n))
    some = walks.where(F.pmod(F.xxhash64("leaf"), F.lit(every)) == 0).select(F.hex(F.substring("walk", 1, BOUND)).alias("w"))
    found = sorted(r["w"] for r in some.collect())
    return ["", *sorted({found[len(found) * i // n] for i in range(1, n)} - {""})] if found else [""]


def _with_part(table_: DataFrame, bounds: list[str]) -> DataFrame:
    part: Column = range_of(F.hex("walk"), F.split(F.lit(",".join(bounds)), ","), len(bounds))
    return table_.withColumn("part", part.cast("int"))


def format_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): the emitted nodes as NODES, and (conv_id, leaf) of each conversation."""
    n = parts(conversations.sparkSession)
    held = cut(paths(conversations))
    # one conversation stands for all that say the same
    stands = held.groupBy("leaf").agg(F.min("conv_id").alias("one")).select("one")
    distinct = held.join(stands, F.col("conv_id").eqNullSafe(F.col("one")), "left_semi")
    bounds = _ranges(distinct.select("leaf", "walk"), n)
    # from here to the second pass: one row for each range
    narrow = _with_part(distinct.select("walk", "lengths"), bounds)
    last, before, upto = {r["part"]: bytes(r["walk"]) for r in narrow.groupBy("part").agg(F.max("walk").alias("walk")).collect()}, {}, b""
    for part in sorted(last):
        before[part], upto = upto, last[part]
    measured = narrow.repartitionById(n, "part").sortWithinPartitions("walk").mapInArrow(_measure(before), _STATE)
    states, at, stack = {}, 0, []
    for r in sorted(measured.collect(), key=lambda r: r["part"]):
        states[r["part"]] = (at, before[r["part"]], stack)
        stack = stack[: r["inherited"]] + [(at + a, at + b) for a, b in zip(r["starts"], r["stops"], strict=True)]
        at += r["total"]
    ordered = _with_part(distinct.select("walk", "turns"), bounds).repartitionById(n, "part").sortWithinPartitions("walk")
    return ordered.mapInArrow(_emit(states), NODES), held.select("conv_id", "leaf")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range's nodes in order, its guests first: what the path to each conversation's last node says."""
    stack: list[tuple] = []
    path = Path()
    for batch in batches:
        out: list[tuple] = []
        names = ("node", "depth", "text", "offset", "loss_start", "loss_stop", "attends", "ends")
        for node, depth, text, offset, start, stop, attends, ends in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            del stack[depth:]
            path.cut(depth)
            if [(a["start"], a["stop"]) for a in attends] != path.runs:
                raise ValueError("a node's ancestors are not where it says")
            stack.append((text, start, stop))
            path.push(offset, offset + len(text))
            if not ends:
                continue
            whole = "".join(x[0] for x in stack)
            learned = "".join(unescape(t[a:b]) for t, a, b in stack)
            digest, turns, at = hashlib.sha256(), 0, 0
            for m in _TURN.finditer(whole):
                if m.start() != at:
                    raise ValueError("the formatted text does not parse")
                at = m.end()
                turns += 1
                digest.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if at != len(whole):
                raise ValueError("the formatted text does not parse")
            out.append((node, turns, digest.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """What each conversation says and trains on, read from the emitted nodes by its last node's intervals.

    The nodes stay in their ranges; a range's first node names all earlier nodes that any of the range can attend
    to, which are sent along as guests: at most one path for each range.
    """
    nodes, ends = cut(nodes), cut(ends)
    n = (nodes.agg(F.max("part")).first()[0] or 0) + 1
    first = nodes.groupBy("part").agg(F.min_by(F.struct("root", "attends"), F.struct("root", "offset")).alias("f"))
    asked = first.select(F.col("part").alias("to"), F.col("f.root").alias("root"), F.explode("f.attends").alias("a")).select("to", "root", "a.start", "a.stop")
    # a run of ancestors holds nothing else of its tree
    guests = nodes.join(F.broadcast(asked), "root").where("offset >= start and offset < stop").withColumn("ends", F.lit(False))
    columns = ["to", "root", "node", "depth", "text", "offset", "loss_start", "loss_stop", "attends", "ends"]
    both = nodes.withColumn("to", F.col("part")).select(*columns).unionByName(guests.select(*columns))
    read = cut(both.repartitionById(n, "to").sortWithinPartitions("root", "offset").mapInArrow(_read, _READ))
    # a last node that more than its share of all conversations have in common: there are at most ``n`` of these
    n = parts(nodes.sparkSession)
    hot = ends.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") > max(1, ends.count() // n)).select("leaf")
    rest = ends.join(F.broadcast(hot), "leaf", "left_anti").join(read, "leaf")
    said = rest.unionByName(ends.join(F.broadcast(read.join(F.broadcast(hot), "leaf")), "leaf"))
    return said.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(*format_chats(given.unionByName(extra)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
    sum(9 + length(role || text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM said
"""
