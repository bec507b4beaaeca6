"""Operator 13: a trie of conversations, as balanced parentheses.

A conversation is a string of turns; each distinct string of its first d turns is a node of depth d, named by a
hash of all turns up to it.  The *walk* of a conversation is the string of its nodes' names, so walks in order are the
trie depth-first.  Distinct walks are dealt to ranges and cut into shards of bounded size.  A shard is encoded as
parentheses, one pair for each node, one bit for each parenthesis, beside arrays over its nodes.

Everything about a node is read from that encoding.  The excess (opened less closed) is kept in blocks with a tree of their
minima and maxima: findclose, the next place with less excess, delimits the subtree; the number of leaves is a
rank over the pairs ``()``; conversations and saved tokens are differences of cumulative arrays.

Nodes on the walk that a shard begins or ends with, its *spine*, may go on in another shard.  Of these a shard gives partial
sums over whatever hangs from them and is complete; spines of all shards merge by node, a few rows for each shard, and are
summed from below.  All other nodes are complete in one shard.

Conversations that say the same are one walk, which stands once in the trie, whatever their number; the digest of their
ids streams over sorted runs of ids, joined to strings before they meet.

Cases: null roles and texts are empty; turns are in order of their number (null first), those that share one by role, then text;
repeated rows are turns of their own; rows without conv_id are no conversation; a conversation without turns ends at the
root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_copies, parts, small_batches, table

#: Bytes of a node's name.
NODE = 16
#: Nodes of one shard, at most, but for one walk.
SHARD_NODES = 1 << 16
#: Ids that are joined to one string.
RUN = 1 << 14
#: Turns that may come from another conversation: fewer than this.
SHARED = 6
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

_WALK = "conv_id long, leaf binary, walk binary, points array<int>"
_RUN = "leaf binary, one long, n long, ids string"
_END = "leaf binary, one long, n long, ends_sha256 string"
SHARD = "n_nodes long, first_depth int, parens binary, nodes binary, points binary, ended binary, one binary, digests binary"
_MEASURED = (
    "node binary, parent binary, spine boolean, asks boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, height long, points long, ends_sha256 string"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "height"]
_SPINE = "node binary, " + ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT)


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, points): the turns of each conversation, numbered from 1, without their texts."""
    blank = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    said = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return turns.where("conv_id is not null").select("conv_id", place.alias("pos"), said.alias("digest"), F.length("text").alias("points"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """in_order's conversations: (conv_id, turns), where the first h turns come from the conversation at the hundred below.

    h: the checksum of the conversation's number, modulo SHARED.
    """
    convs = turns.select("conv_id").distinct()
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    theirs = turns.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", "digest", "points")
    asked = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    shared = asked.join(theirs, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "points")
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "points")
    without = convs.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("points"))
    every = shared.unionByName(own).unionByName(without)
    listed = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("part", "pos", "digest", "points"))))
    return every.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["points"].alias("points"))).alias("turns"))


def as_they_are(turns: DataFrame) -> DataFrame:
    """in_order's conversations: (conv_id, turns), not rebuilt."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "points")))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["points"].alias("points"))).alias("turns"))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves, walks, points = [], [], []
        for turns in batch.column("turns").to_pylist():
            node, walk = b"", []
            for turn in turns:
                node = hashlib.blake2b(node + turn["digest"], digest_size=NODE).digest()
                walk.append(node)
            leaves.append(node)
            walks.append(b"".join(walk))
            points.append([turn["points"] for turn in turns])
        columns = [batch.column("conv_id"), pa.array(leaves, pa.binary()), pa.array(walks, pa.binary()), pa.array(points, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "leaf", "walk", "points"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (leaf, conv_id) in order: the ids of each leaf as strings of bounded length."""
    leaf, held = None, []
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    rows: list[tuple] = []
    for batch in batches:
        for now, conv_id in zip(batch.column("leaf").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (now != leaf or len(held) == RUN):
                rows.append((leaf, held[0], len(held), ",".join(map(str, held))))
                held = []
            leaf = now
            held.append(conv_id)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["leaf", "one", "n", "ids"])
            rows = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((leaf, held[0], len(held), ",".join(map(str, held))), kinds, strict=True)], ["leaf", "one", "n", "ids"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs of ids in order: one row for each leaf, with the digest of all its ids."""
    leaf, one, total, digest = None, 0, 0, hashlib.sha256()
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for now, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("leaf", "one", "n", "ids")), strict=True):
            if total and now != leaf:
                rows.append((leaf, one, total, digest.hexdigest()))
                total, digest = 0, hashlib.sha256()
            if total:
                digest.update(b",")
            else:
                leaf, one = now, first
            total += n
            digest.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["leaf", "one", "n", "ends_sha256"])
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((leaf, one, total, digest.hexdigest()), kinds, strict=True)], ["leaf", "one", "n", "ends_sha256"])


def _shared(a: bytes, b: bytes) -> int:
    """Nodes that two walks have in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // NODE
    at = 0
    while a[at : at + NODE] == b[at : at + NODE]:
        at += NODE
    return at // NODE


class Shard:
    """Parentheses and node arrays of some walks in order; node 0 is the root."""

    def __init__(self):
        self.parens, self.last, self.first_depth = bytearray(), b"", None
        self.nodes, self.points, self.ended, self.one, self.digests = [b"\0" * NODE], [0], [0], [NONE], [b"\0" * 32]
        self.parens.append(1)

    def add(self, walk: bytes, points: list[int], n: int, one: int, digest: str) -> None:
        common, depth = _shared(self.last, walk), len(points)
        if self.first_depth is None:
            self.first_depth = depth
        self.parens += b"\0" * (len(self.last) // NODE - common) + b"\1" * (depth - common)
        new = depth - common
        self.nodes += [walk[a : a + NODE] for a in range(common * NODE, len(walk), NODE)]
        self.points += points[common:]
        self.ended += [0] * new
        self.one += [NONE] * new
        self.digests += [b"\0" * 32] * new
        self.ended[-1], self.one[-1], self.digests[-1] = n, one, bytes.fromhex(digest)
        self.last = walk

    def row(self) -> pa.RecordBatch:
        parens = self.parens + b"\0" * (len(self.last) // NODE + 1)
        packed = np.packbits(np.frombuffer(parens, np.uint8)).tobytes()
        arrays = [packed, b"".join(self.nodes), np.array(self.points, "<i4").tobytes(), np.array(self.ended, "<i8").tobytes(), np.array(self.one, "<i8").tobytes(), b"".join(self.digests)]
        columns = [pa.array([len(self.nodes)], pa.int64()), pa.array([self.first_depth], pa.int32()), *(pa.array([x], pa.binary()) for x in arrays)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARD.split(", ")])


def _encode(most: int):
    """Over distinct walks in order: shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("walk", "points", "n", "one", "ends_sha256")), strict=True):
                if shard.first_depth is not None and len(shard.nodes) + len(row[1]) > most:
                    yield shard.row()
                    shard = Shard()
                shard.add(*row)
        if shard.first_depth is not None:
            yield shard.row()

    return run


class Parens:
    """Balanced parentheses: excess in blocks, under a tree of the blocks' minima and maxima."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits, self.excess = bits, np.cumsum(np.where(bits, 1, -1))
        n = -(-len(bits) // self.BLOCK)
        self.size = 1 << (n - 1).bit_length()
        self.padded = np.full(self.size * self.BLOCK, NONE)
        self.padded[: len(bits)] = self.excess
        self.least = np.full(2 * self.size, NONE)
        self.least[self.size :] = self.padded.reshape(-1, self.BLOCK).min(axis=1)
        highest = np.where(self.padded == NONE, 0, self.padded).reshape(-1, self.BLOCK)
        self.most = np.zeros(2 * self.size, np.int64)
        self.most[self.size :] = highest.max(axis=1)
        at = self.size
        while at > 1:
            half = at // 2
            self.least[half:at] = np.minimum(self.least[at : 2 * at : 2], self.least[at + 1 : 2 * at : 2])
            self.most[half:at] = np.maximum(self.most[at : 2 * at : 2], self.most[at + 1 : 2 * at : 2])
            at = half
        pairs = np.zeros(len(bits) + 1, np.int64)
        np.cumsum(np.append(bits[:-1] & ~bits[1:], False), out=pairs[1:])
        self.pairs = pairs

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where each opened pair closes: the first place after it with less excess."""
        below = self.excess[opens] - 1
        out, at = np.zeros(len(opens), np.int64), opens + 1
        live = self._scan(np.arange(len(opens)), at, below, out)
        # on to the next blocks: up and right in the tree to the first with such a place, then down
        node = self.size + at[live] // self.BLOCK
        while (miss := self.least[node] > below[live]).any():
            right = node + 1
            node = np.where(miss, np.where(right & 1 == 1, right, right >> 1), node)
        while (inner := node < self.size).any():
            left = 2 * np.minimum(node, self.size - 1)
            node = np.where(inner, np.where(self.least[left] <= below[live], left, left + 1), node)
        at[live] = (node - self.size) * self.BLOCK
        self._scan(live, at, below, out)
        return out

    def _scan(self, live: np.ndarray, at: np.ndarray, below: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Step through one block; those that found nothing by its end, with ``at`` on the next block."""
        ended = [live[at[live] % self.BLOCK == 0][:0]]
        while len(live):
            hit = self.padded[at[live]] <= below[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            over = at[live] % self.BLOCK == 0
            ended.append(live[over])
            live = live[~over]
        return np.concatenate(ended)

    def highest(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The greatest excess between two places, both included."""
        first, last = opens // self.BLOCK, closes // self.BLOCK
        out = self.excess[opens].copy()
        for step in range(self.BLOCK):
            for place in (opens + step, closes - step):
                inside = (place >= opens) & (place <= closes) & ((place // self.BLOCK == first) | (place // self.BLOCK == last))
                out[inside] = np.maximum(out[inside], self.excess[place[inside]])
        a, b = first + 1 + self.size, last + self.size  # whole blocks between: [a, b)
        while (open_ := a < b).any():
            take = open_ & (a & 1 == 1)
            out[take] = np.maximum(out[take], self.most[a[take]])
            a = np.where(take, a + 1, a)
            take = open_ & (b & 1 == 1)
            b = np.where(take, b - 1, b)
            out[take] = np.maximum(out[take], self.most[b[take]])
            a, b = np.where(open_, a >> 1, a), np.where(open_, b >> 1, b)
        return out


def range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each range [a, b), none of them empty, from minima over powers of two."""
    tables, out = [values], np.zeros(len(a), np.int64)
    while 2 << (len(tables) - 1) <= len(values):
        half, last = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp((b - a).astype(float))[1] - 1
    for k in np.unique(level).tolist():
        some = level == k
        out[some] = np.minimum(tables[k][a[some]], tables[k][b[some] - (1 << k)])
    return out


def measures(row: dict) -> dict[str, np.ndarray]:
    """What one shard says of its nodes; of those in ``spine`` only what is complete below them."""
    n = row["n_nodes"]
    parens = Parens(np.unpackbits(np.frombuffer(row["parens"], np.uint8), count=2 * n).astype(bool))
    points, ended, one = (np.frombuffer(row[c], k).astype(np.int64) for c, k in (("points", "<i4"), ("ended", "<i8"), ("one", "<i8")))
    opens = np.flatnonzero(parens.bits)
    closes = parens.find_close(opens)
    node = np.arange(n)
    stop = node + (closes - opens + 1) // 2
    depth = parens.excess[opens] - 1
    order = np.lexsort((node, depth))
    key = depth[order] * n + node[order]
    parent = np.where(node > 0, key[np.searchsorted(key, (depth - 1) * n + node) - 1] % n, -1)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    over = lambda c: c[stop] - c[node]
    n_convs = over(sums(ended))
    spine = np.zeros(n, bool)
    spine[: row["first_depth"] + 1] = True
    at = n - 1
    while at >= 0:
        spine[at] = True
        at = parent[at]
    gain = np.where(spine, 0, (n_convs - 1) * points)
    leaves = parens.pairs[closes] - parens.pairs[opens]
    height = parens.highest(opens, closes) - 1 - depth
    children = np.bincount(parent[1:], minlength=n)
    # of a spine only what hangs from it and is no spine
    hangs = ~spine & (parent >= 0) & spine[parent]
    below = lambda x: np.bincount(parent[hangs], weights=x[hangs].astype(float), minlength=n).astype(np.int64)
    saved = over(sums(gain))
    tall = np.zeros(n, np.int64)
    np.maximum.at(tall, parent[hangs], height[hangs] + 1)
    return {
        "parent": parent, "spine": spine, "depth": depth, "n_convs": n_convs, "points": points, "ended": ended, "conv_id": range_least(one, node, stop),
        "n_children": np.where(spine, below(np.ones(n)), children), "n_leaves": np.where(spine, below(leaves), leaves),
        "saved_tokens": np.where(spine, _sum_at(parent, saved, hangs, n), saved), "height": np.where(spine, tall, height),
    }


def _sum_at(parent: np.ndarray, values: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, parent[some], values[some])
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _MEASURED.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            m = measures(row)
            n, parent = row["n_nodes"], m["parent"]
            cuts = [row["nodes"][a : a + NODE] for a in range(0, n * NODE, NODE)]
            asks = ~m["spine"] & m["spine"][parent]
            known = (m["conv_id"] != NONE) & ~m["spine"][parent] & (parent >= 0)
            conv = m["conv_id"]
            digests = [row["digests"][32 * i : 32 * i + 32].hex() if e else (None if s else EMPTY) for i, (e, s) in enumerate(zip(m["ended"].tolist(), m["spine"].tolist(), strict=True))]
            columns = [
                pa.array(cuts, pa.binary()), pa.array([cuts[p] if p >= 0 else None for p in parent.tolist()], pa.binary()), pa.array(m["spine"]), pa.array(asks),
                pa.array(conv, pa.int64()), pa.array(m["depth"], pa.int64()), pa.array(conv[parent], pa.int64(), mask=~known),
                *(pa.array(m[c], pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "height", "points")), pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spines of all shards, one row for each node: complete, from the deepest up."""
    rows = {r["node"]: r for batch in batches for r in batch.to_pylist()}
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["points"]
        up = rows.get(r["parent"])
        r["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            up["height"] = max(up["height"], r["height"] + 1)
    if rows:
        kind = pa.schema([("node", pa.binary()), *((c, pa.string() if c == "ends_sha256" else pa.int64()) for c in RESULT)])
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in kind.names} for r in rows.values()], kind)


def encode_trie(conversations: DataFrame) -> DataFrame:
    """Shards of the trie of conversations (conv_id, turns as of rebuilt), as SHARD."""
    spark = conversations.sparkSession
    small_batches(spark)
    n = parts(spark)
    held = cut(conversations.mapInArrow(_walks, _WALK))
    runs = held.select("leaf", "conv_id").repartitionByRange(n, "leaf", "conv_id").sortWithinPartitions("leaf", "conv_id").mapInArrow(_runs, _RUN)
    ends = runs.repartition(n, "leaf").sortWithinPartitions("leaf", "one").mapInArrow(_ends, _END)
    distinct = cut(ends.join(held.select(F.col("conv_id").alias("one"), "walk", "points"), "one").select("walk", "points", "n", "one", "ends_sha256"))
    return distinct.repartitionByRange(n, "walk").sortWithinPartitions("walk").mapInArrow(_encode(SHARD_NODES), SHARD)


def trie_nodes(shards: DataFrame) -> DataFrame:
    """All nodes of encode_trie's shards, as RESULT."""
    found = cut(shards.mapInArrow(_measure, _MEASURED))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    ends = F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256")
    partial = found.where("spine").groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("height").alias("height"), F.max("points").alias("points"), *sums, ends)
    # a few rows for each shard
    spines = cut(partial.repartition(1).mapInArrow(_merge, _SPINE))
    whole = found.where("not spine and not asks").select(*RESULT)
    # a spine node may have any number of children
    above = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("times"))
    hanging = join_copies(found.where("asks").drop("parent_conv_id"), above, ["parent"], "times").withColumnRenamed("above", "parent_conv_id").select(*RESULT)
    return whole.unionByName(hanging).unionByName(spines.select(*RESULT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(encode_trie(rebuilt(in_order(table(spark, sf_dir, "conversations")))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda k: (ascii(x)::BIGINT >> k) & 1))) AS bits FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), said AS (
  SELECT conv_id, length(text) AS points, row_number() OVER w AS depth,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY part, pos)) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), paths AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS points FROM convs UNION ALL SELECT conv_id, depth, node, points FROM said
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(points) AS points,
    sha256(coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM linked GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT DISTINCT a.node, b.node AS under FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), subtree AS (
  SELECT b.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.points) AS saved_tokens, max(n.depth) AS deepest
  FROM below b JOIN nodes n ON n.node = b.under LEFT JOIN children c ON c.node = b.under GROUP BY b.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256, (s.deepest - n.depth)::BIGINT AS height
FROM nodes n JOIN subtree s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
