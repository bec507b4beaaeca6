"""Operator 7: document fingerprints by randomised edit embedding.

A walker goes over the text's characters. At every step it writes the character under it and moves
on or stays by a random bit that depends on the step and the character only; texts that differ by few
edits fall into step again, so their embeddings differ in few places. The embedding itself is never
written out: for each character the step at which the walker leaves it is one look-up in a table of
the (periodic) random bits, and only sampled places of the embedding are read.

Sampling is nested: a place is sampled at level t if its hash has t trailing zero bits. A text takes
the level that leaves about ``SAMPLES`` places, and two texts are compared at the coarser of their
levels. The likeness is the share of sampled places, up to the end of the longer embedding, that
carry the same symbol; a symbol is a hash of three characters, so chance agreement is rare.

``near_classes`` bands the fingerprints: equal texts are first made one member, each band is a hash of ``ROWS``
sampled symbols, and members of one band bucket are verified against each other on all their samples, block by
block. What leaves a task is one edge for each member to the least member it is connected with; alternating
stars turn the edges into classes, so chains of near texts are one class. A text is banded at its own level, and at
the next coarser one if a text of ``NEAR`` likeness could be long enough for that.

Cases: null counts as empty; two empty texts are alike (1.0), an empty and another are not (0.0); rows
that share a doc_id are ordered by text; one document is its own next one; an empty text is near to
empty texts only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_copies, keyed, parts, range_of, table
from .components import components
from .windows import mix

#: Places of the embedding that a fingerprint samples, about; it has between half as many and as many.
SAMPLES = 256
#: Period of the walk's random bits, and classes of characters that get bits of their own.
PERIOD, CLASSES = 4096, 64
#: Characters walked at once: documents side by side times the length of the longest.
MATRIX = 1 << 21

#: Likeness that counts as near, and how it is found: bands of so many symbols. A pair at exactly NEAR is
#: found with probability 0.97 (1 - (1 - NEAR^ROWS)^BANDS); closer pairs more often.
NEAR, BANDS, ROWS = 0.8, 12, 6
#: Members of a bucket that meet in one task; larger buckets meet block by block.
BLOCK = 512

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def walk_table(seed: int = 7) -> np.ndarray:
    """leaves[c * PERIOD + step]: how many steps, 1 at least, the walker stays on a character of class c."""
    bits = np.random.default_rng(seed).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    stay = np.empty((CLASSES, PERIOD), np.int64)
    wait = np.zeros(CLASSES, np.int64)
    for step in [*range(PERIOD - 1, -1, -1)] * 2:
        wait = np.where(bits[:, step], 1, wait + 1)
        stay[:, step] = wait
    return stay.ravel()


def _place_hash(places: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(places.astype(np.uint64) + np.uint64(0x1234567))


def sampled_places(limit: int) -> list[np.ndarray]:
    """Places of the embedding below ``limit`` that each level samples."""
    places = np.arange(limit)
    out, hashed = [], _place_hash(places)
    while True:
        out.append(places)
        if len(places) <= 1:
            return out
        keep = (hashed >> np.uint64(len(out) - 1)) & np.uint64(1) == 0
        places, hashed = places[keep], hashed[keep]


class Embedding:
    """Fingerprints of batches of texts; the tables grow with the longest text seen."""

    def __init__(self):
        self.stay, self.limit, self.levels = walk_table(), 0, []

    def grow(self, limit: int) -> None:
        if limit > self.limit:
            self.limit = 1 << limit.bit_length()
            self.levels = sampled_places(self.limit)

    def level(self, steps: int) -> int:
        return max(0, (-(-steps // SAMPLES) - 1).bit_length())

    def fingerprints(self, texts: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
        """(level, steps, symbols) of each text, given as code points."""
        out: list = [(0, 0, b"")] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: len(texts[i]))
        while order:
            longest = len(texts[order[-1]])
            take = max(1, MATRIX // longest)
            for i, found in self._walk(texts, order[-take:]):
                out[i] = found
            del order[-take:]
        return out

    def _walk(self, texts, group):
        n = np.array([len(texts[i]) for i in group])
        most = int(n.max())
        with np.errstate(over="ignore"):
            classes = np.zeros((most, len(group)), np.uint8)
            for k, i in enumerate(group):
                classes[: n[k], k] = mix(texts[i].astype(np.uint64)) & np.uint64(CLASSES - 1)
        base = np.arange(CLASSES) * PERIOD
        leave = np.empty((most, len(group)), np.int32)
        step = np.zeros(len(group), np.int64)
        for k in range(most):
            step = step + self.stay[base[classes[k]] + (step & (PERIOD - 1))]
            leave[k] = step
        for k, i in enumerate(group):
            at = leave[: n[k], k]
            steps = int(at[-1])
            self.grow(steps + 1)
            level = self.level(steps)
            places = self.levels[min(level, len(self.levels) - 1)]
            places = places[: np.searchsorted(places, steps)]
            here = np.searchsorted(at, places, side="right")
            text = np.concatenate([texts[i], np.zeros(2, texts[i].dtype)]).astype(np.uint64)
            with np.errstate(over="ignore"):
                three = text[here] + (text[here + 1] << np.uint64(21)) + (text[here + 2] << np.uint64(42))
                yield i, (level, steps, (mix(three) & np.uint64(255)).astype(np.uint8).tobytes())

    def likeness(self, a: tuple, b: tuple) -> float:
        (la, sa, xa), (lb, sb, xb) = a, b
        if sa == 0 or sb == 0:
            return float(sa == sb)
        level = min(max(la, lb), len(self.levels) - 1)
        common = self.levels[level]
        most = np.searchsorted(common, max(sa, sb))
        if most == 0:
            return float(a == b)
        least = common[: np.searchsorted(common, min(sa, sb))]

        def at(level_x, x):
            own = self.levels[min(level_x, len(self.levels) - 1)]
            return np.frombuffer(x, np.uint8)[np.searchsorted(own, least)]

        return float((at(la, xa) == at(lb, xb)).sum() / most)


def text_of(found: tuple) -> str:
    level, steps, symbols = found
    return f"{level:02x}{steps:012x}{symbols.hex()}"


def from_text(text: str) -> tuple[int, int, bytes]:
    return int(text[:2], 16), int(text[2:14], 16), bytes.fromhex(text[14:])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(rows: Iterator[tuple], most: int = 4 << 20):
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[-1])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _fingerprint_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (part, guest, key, text is there): each document with the one after it in its part.

    The last row of a part is the first row of the next part (``guest``), which only lends its text. A row
    without text carries the class of the document after it.
    """
    embedding = Embedding()

    def rows():
        class_of = None
        for batch in batches:
            for key, part, doc_id, guest, class_key, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "doc_id", "guest", "class_key", "text")), strict=True):
                if text is None:
                    class_of = (key, class_key)
                else:
                    yield part, doc_id, guest, class_of[1] if class_of is not None and class_of[0] == key else key, text

    carry = None
    for block in _blocks(rows()):
        if carry is not None:
            block = [carry, *block]
        carry = block[-1]
        if len(block) > 1:
            yield from _some(embedding, block)


def _some(embedding: Embedding, block: list[tuple]) -> Iterator[pa.RecordBatch]:
    texts = [row[4] for row in block]
    pairs = [i for i in range(len(block) - 1) if not block[i][2] and block[i][0] == block[i + 1][0]]
    if not pairs:
        return
    edited = []
    for i in pairs:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    found = embedding.fingerprints([_points(t) for t in texts + edited])
    own, other = found[: len(texts)], found[len(texts) :]
    columns = [
        pa.array([block[i][1] for i in pairs], pa.int64()),
        pa.array([len(texts[i]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array([text_of(own[i]) for i in pairs]),
        pa.array([text_of(x) for x in other]),
        pa.array([embedding.likeness(own[i], other[k]) for k, i in enumerate(pairs)], pa.float64()),
        pa.array([embedding.likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
        pa.array([block[i][3] for i in pairs], pa.int64()),
    ]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def ranges(base: DataFrame, n: int) -> list[int]:
    """First keys of at most ``n`` ranges of about as many rows each; every one is a key of the table."""
    asked = F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n) if n > 1 else F.array().cast("array<bigint>")
    found = base.agg(F.min("key").alias("least"), asked.alias("some")).first()
    return sorted({int(k) for k in [found["least"], *(found["some"] or [])] if k is not None}) or [0]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """RESULT for every document: its fingerprint, its edited text's, their likeness, and its class of near texts.

    Documents are dealt to ranges of their key by one shuffle. The first document of a range is also
    sent to the range before it (of the first range: to the last), where the last one needs its text.
    """
    base = keyed(docs).select("key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = near_classes(base)
    n = parts(docs.sparkSession)
    bounds = ranges(base, n)
    firsts, m = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), len(bounds)
    placed = base.withColumn("part", range_of(F.col("key"), firsts, m))
    here = F.struct(F.col("part"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(m)).cast("int").alias("part"), F.lit(True).alias("guest"))
    sent = F.when(F.get(firsts, F.col("part")) == F.col("key"), F.array(here, before)).otherwise(F.array(here))
    dealt = placed.select("key", "doc_id", "text", F.explode(sent).alias("to")).select("to.part", "to.guest", "key", "doc_id", "text", F.lit(None).cast("long").alias("class_key"))
    told = classes.select(range_of(F.col("key"), firsts, m).alias("part"), F.lit(False).alias("guest"), "key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "class_key")
    ordered = dealt.unionByName(told).repartitionById(n, "part").sortWithinPartitions("guest", "key", F.col("text").isNotNull())
    return ordered.mapInArrow(_fingerprint_edits, RESULT)


def _band_places(tier: int) -> np.ndarray:
    """BANDS rows of ROWS sampled places each that every text of a tier (2^tier < steps <= 2^(tier + 1)) has."""
    places = np.arange(1 << max(tier, 0))
    level = max(0, (2 << max(tier, 0)) // SAMPLES).bit_length() - 1
    if level > 0:
        places = places[_place_hash(places) & np.uint64((1 << level) - 1) == 0]
    rng = np.random.default_rng([tier + 1, 77])
    return places[np.stack([rng.permutation(len(places))[:ROWS] for _ in range(BANDS)])]


class Bands:
    """Hashes of ROWS sampled symbols each, in a text's own tier of lengths and, if it is long for that, the next one."""

    def __init__(self, embedding: Embedding):
        self.embedding, self.tiers = embedding, {}

    def of(self, found: tuple) -> list[int]:
        level, steps, symbols = found
        if not steps:
            return []
        self.embedding.grow(steps + 1)
        own = self.embedding.levels[min(level, len(self.embedding.levels) - 1)]
        values = np.frombuffer(symbols, np.uint8).astype(np.uint64)
        tier = (steps - 1).bit_length() - 1
        out = []
        for t in (tier, tier + 1) if steps > 0.95 * NEAR * 2.0 ** (tier + 1) else (tier,):
            if t not in self.tiers:
                self.tiers[t] = _band_places(t)
            places = self.tiers[t]
            places = places[(places < steps).all(1)]
            with np.errstate(over="ignore"):
                mixed = mix(values[np.searchsorted(own, places)] + mix(places.astype(np.uint64))).sum(1, dtype=np.uint64)
                out += mix(mixed + np.uint64(t + 2) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()
        return list(dict.fromkeys(out))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    embedding = Embedding()
    for batch in batches:
        for block in _blocks(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            found = embedding.fingerprints([_points(t) for _, t in block])
            digests = np.array([np.frombuffer(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64) for _, t in block])
            columns = [
                pa.array([k for k, _ in block], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "d1", "d2", "level", "steps", "symbols"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = Bands(Embedding())
    for batch in batches:
        keys, buckets = [], []
        for key, *found in zip(*(batch.column(c).to_pylist() for c in ("key", "level", "steps", "symbols")), strict=True):
            hashes = bands.of(tuple(found))
            keys += [key] * len(hashes)
            buckets += hashes
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(keys, pa.int64())], ["bucket", "key"])


def likenesses(embedding: Embedding, members: list[tuple]) -> np.ndarray:
    """The likeness of every two members (level, steps, symbols), as Embedding.likeness gives it."""
    n = len(members)
    level, steps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    out = np.zeros((n, n))
    for t in np.unique(level):
        upto = np.flatnonzero(level <= t)
        places = embedding.levels[min(t, len(embedding.levels) - 1)]
        inside = np.searchsorted(places, steps)
        width = int(inside[upto].max())
        rows = np.full((len(upto), width), -1, np.int16)
        for r, i in enumerate(upto):
            own = embedding.levels[min(level[i], len(embedding.levels) - 1)]
            rows[r, : inside[i]] = np.frombuffer(members[i][2], np.uint8)[np.searchsorted(own, places[: inside[i]])]
        blank = np.where(rows < 0, -2, rows)
        for r in np.flatnonzero(level[upto] == t):
            i = upto[r]
            most = np.maximum(inside[i], inside[upto])
            alike = np.where(most > 0, (rows == blank[r]).sum(1) / np.maximum(most, 1), [members[i] == members[j] for j in upto])
            out[i, upto] = out[upto, i] = alike
    return out


def _verify(near: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (bucket, left, right): an edge from each member to the least one it is connected with."""
    embedding = Embedding()

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "left", "right", "key", "side", "level", "steps", "symbols")), strict=True)

    def edges(group):
        keys, side = np.array([r[3] for r in group]), np.array([r[4] for r in group])
        embedding.grow(max(r[6] for r in group) + 1)
        link = likenesses(embedding, [tuple(r[5:8]) for r in group]) >= near
        if group[0][1] != group[0][2]:
            link &= side[:, None] != side[None, :]
        np.fill_diagonal(link, True)
        order = np.argsort(np.argsort(keys))  # ranks, so that the least label is the least key
        least = order
        while True:
            new = np.where(link, least[None, :], len(keys)).min(1)
            if (new == least).all():
                break
            least = new
        by_rank = np.sort(keys)
        moved = least != order
        return pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(by_rank[least[moved]])], ["a", "b"])

    group: list = []
    for row in rows():
        if group and group[0][:3] != row[:3]:
            if len(group) > 1:
                yield edges(group)
            group = []
        group.append(row)
    if len(group) > 1:
        yield edges(group)


def near_classes(keyed_docs: DataFrame, near: float = NEAR) -> DataFrame:
    """(key, class_key) of every document that is not alone: the least key of the texts it is linked with by any
    chain of near fingerprints, or of equal texts. Documents (key, text) without a row are a class each."""
    n = parts(keyed_docs.sparkSession)
    prints = cut(keyed_docs.select("key", "text").mapInArrow(_prints, "key long, d1 long, d2 long, level int, steps long, symbols binary"))
    copies = prints.groupBy("d1", "d2").agg(F.min("key").alias("copy_key"), F.count("*").alias("copies"))
    firsts = prints.join(copies.select(F.col("copy_key").alias("key")), "key", "left_semi")
    banded = firsts.mapInArrow(_bands, "bucket long, key long")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.min("key").alias("least")).where("m > 1")
    # buckets with the same members as another bring nothing new
    kept = buckets.groupBy("m", "who", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    met = cut(banded.join(kept, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    own = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    # block i meets every block j >= i: its members go to (i, j) as the left side and to (j, i) as the right one
    dealt = met.withColumn("own", own).select("bucket", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = dealt.select("bucket", "key", F.least("own", "j").alias("left"), F.greatest("own", "j").alias("right"), (F.col("own") > F.col("j")).cast("int").alias("side"))
    sides = dealt.join(prints.select("key", "level", "steps", "symbols"), "key").repartition(n, "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "key")
    edges = sides.mapInArrow(partial(_verify, near), "a long, b long")
    roots = components(edges)
    texts = cut(copies.join(roots, F.col("copy_key") == F.col("node"), "left").select("d1", "d2", "copies", F.coalesce("root", "copy_key").alias("class_key")))
    found = join_copies(prints.select("key", "d1", "d2"), texts, ["d1", "d2"], "copies").select("key", "class_key")
    return cut(found.where("key <> class_key"))


def op7_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
