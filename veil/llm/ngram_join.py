"""Operator 5: n-gram Jaccard self-join by MinHash banding.

A document's set is its hashed runs of five words (of all its words if it has one to four).  Documents with
equal sets are one class member: the join runs between one of each.  MinHash signatures are cut into
bands; rows and bands follow from the recall wanted at the similarity threshold.  Band hashes are
shuffled; buckets with one member end there, and so do buckets with the same members as another.
Members of the remaining buckets meet by blocks: pairs are verified on their full n-gram sets inside the
task, a pair counts in the first bucket it shares, and what leaves the task is a count of links for each
member and one edge from each member to the least one it is connected with.  Alternating stars turn the edges
into classes.

Cases: null texts and texts without words have no set, so they are a class each and link to nothing; rows that
share a doc_id (or have none) are separate documents; repeated rows and equal texts share a class; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W
from .common import cut, flat, join_copies, keyed, keyed_rows, parts, table
from .components import components
from .repeats import _whole, word_bounds, word_symbols

GRAM = 5
SIMILARITY = 0.8
#: Share of the pairs at exactly the threshold that banding must find.
RECALL = 0.9999
ROWS = 4
#: Members of a bucket that meet at once, and n-grams of theirs (8 bytes each); larger buckets meet block by block.
BLOCK, BLOCK_GRAMS = 512, 1 << 21

RESULT = "doc_id long, class_id long, copy_of long, n_links long"


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows that find a pair of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram: int, twice: bool = False):
    """Distinct hashed n-grams of each text, sorted: (hashes, offsets); twice: and hashes of an independent family, in that order."""
    a, b, first, last = word_bounds(data, starts, ends)
    n = last - first
    runs = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), runs)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)

    def hashed(family: int) -> np.ndarray:
        symbols, value = word_symbols(data, a, b, family), np.zeros(len(doc), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(gram):
                inside = at + j < last[doc]
                value[inside] = W.mix(value[inside] * np.uint64(0x100000001B3) + symbols[at[inside] + j])
        return value

    value = hashed(0)
    order = np.lexsort((value, doc))
    value, of = value[order], doc[order]
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(of)]
    offsets = np.searchsorted(of[new], np.arange(len(n) + 1))
    return (value[new], offsets, hashed(1)[order][new]) if twice else (value[new], offsets)


def _signatures(gram: int, rows: int, bands: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(11)
    multiply = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64)
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        data, starts, ends = flat(batch.column("text"))
        for group in _whole(starts, ends):
            lo, hi = starts[group[0]], ends[group[-1]]
            value, offsets, other = shingle_sets(data[lo:hi], starts[group] - lo, ends[group] - lo, gram, True)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            out = np.zeros((len(group), bands), np.uint64)
            digest = np.zeros((len(group), 2), np.uint64)
            if len(full):
                at = offsets[:-1][full]
                with np.errstate(over="ignore"):
                    for k, hashes in enumerate((value, other)):
                        digest[full, k] = np.add.reduceat(W.mix(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)), at)
                    for band in range(bands):
                        mixed = np.zeros(len(full), np.uint64)
                        for r in range(band * rows, (band + 1) * rows):
                            x = value * multiply[r] + add[r]
                            x ^= x >> np.uint64(31)
                            mixed = W.mix(mixed * np.uint64(31) + np.minimum.reduceat(x * multiply[r], at))
                        out[full, band] = mixed
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1) * bands, pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[group]), batch.column("doc_id").take(pa.array(group)), pa.array(count), pa.array(digest[:, 0].copy().view(np.int64)), pa.array(digest[:, 1].copy().view(np.int64)), listed],
                ["key", "doc_id", "n", "d1", "d2", "bands"],
            )


def _sets(gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each member, with what the join needs beside it."""
    for batch in batches:
        data, starts, ends = flat(batch.column("text"))
        for group in _whole(starts, ends):
            lo, hi = starts[group[0]], ends[group[-1]]
            value, offsets = shingle_sets(data[lo:hi], starts[group] - lo, ends[group] - lo, gram)
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))
            pick = pa.array(group)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pick), batch.column("kept").take(pick), batch.column("places").take(pick), listed], ["key", "kept", "places", "grams"])


def _meet(similarity: float, keys, side, across: bool, kept, grams, offsets, band: int):
    """Links and least connected member among the members of one bucket's two blocks.

    side: 0 or 1, the block of each member; across: only pairs of different blocks count.
    """
    n = len(keys)
    size = np.diff(offsets)
    member = np.repeat(np.arange(n), size)
    classes, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    del classes
    shared = times[inverse] > 1
    column = np.cumsum(times > 1) - 1
    column, member = column[inverse[shared]], member[shared]
    inter = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, member = column[order], member[order]
    step = max(256, (1 << 22) // max(n, 1))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [c, c + step])
        dense = np.zeros((n, step), np.float32)
        dense[member[a:b], column[a:b] - c] = 1
        inter += dense @ dense.T
    link = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-3
    np.fill_diagonal(link, False)
    if across:
        link &= side[:, None] != side[None, :]
    first = link.copy()
    for earlier in range(band):
        if not first.any():
            break
        x = kept[:, earlier]
        first &= ~((x[:, None] == x[None, :]) & (x != 0)[:, None])
    least, number = np.arange(n), np.arange(n)
    while True:
        low = np.where(link, least[None, :], n).min(1, initial=n)
        new = np.minimum(least, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    return first.sum(1), keys[least], number != least


def _verify(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (band, bucket, left, right): the pairs of each bucket's block pair."""

    def rows():
        for batch in batches:
            grams, kept = batch.column("grams"), batch.column("kept")
            go, gv = np.asarray(grams.offsets), grams.values.to_numpy(zero_copy_only=False)
            ko, kv = np.asarray(kept.offsets), kept.values.to_numpy(zero_copy_only=False)
            names = ("band", "bucket", "left", "right", "key", "side")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                yield row, kv[ko[i] : ko[i + 1]], gv[go[i] : go[i + 1]]

    def send(group):
        if len(group) < 2:
            return
        keys = np.array([row[4] for row, _, _ in group], np.int64)
        side = np.array([row[5] for row, _, _ in group])
        grams = [g for _, _, g in group]
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        links, least, joined = _meet(similarity, keys, side, group[0][0][2] != group[0][0][3], np.stack([k for _, k, _ in group]), np.concatenate(grams), offsets, group[0][0][0])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links.astype(np.int64)), pa.array(np.where(joined, least, keys))], ["key", "links", "least"])

    group: list = []
    for row in rows():
        if group and group[0][0][:4] != row[0][:4]:
            yield from send(group)
            group = []
        group.append(row)
    yield from send(group)


def ngram_join(docs: DataFrame, gram: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(key, doc_id, class_key, copy_key, n_links) for every document.

    class_key: least key of the documents linked with it through any chain of links; copy_key: least
    key with the same set; n_links: other sets of at least that Jaccard similarity.
    """
    return join_keyed(keyed(docs), gram, similarity, recall, rows)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least key of every class."""
    base = keyed_rows(docs)
    kept = join_keyed(base).where("key = class_key").select("key")
    return base.join(kept, "key", "left_semi").select("row.*")


def join_keyed(keyed_docs: DataFrame, gram: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    n = parts(keyed_docs.sparkSession)
    bands = bands_for(recall, similarity, rows)
    base = keyed_docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = cut(base.mapInArrow(partial(_signatures, gram, rows, bands), "key long, doc_id long, n long, d1 long, d2 long, bands array<long>"))
    copies = cut(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("key").alias("copy_key"), F.count("*").alias("copies")))
    firsts = signed.join(copies.select(F.col("copy_key").alias("key")), "key", "left_semi").select("key", "n", "bands")
    banded = cut(firsts.select("key", "n", F.posexplode("bands").alias("band", "bucket")))
    # buckets with the same members as one of an earlier band bring nothing new
    buckets = banded.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.min("key").alias("least"), F.sum("n").alias("grams")).where("m > 1")
    kept = buckets.groupBy("m", "who", "least", "grams").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "m", "grams")
    in_bucket = banded.drop("n").join(kept, ["band", "bucket"])
    # large buckets are dealt into blocks by the members' hashes; each pair of blocks meets once
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    own = F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int")
    placed = in_bucket.withColumn("blocks", blocks).withColumn("block", own).select("key", F.struct("band", "bucket", "block", "blocks").alias("place"))
    members = placed.groupBy("key").agg(F.collect_list("place").alias("places"))
    by_band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.try_element_at(F.map_from_entries(F.transform("places", lambda p: F.struct(p["band"], p["bucket"]))), b), F.lit(0)))
    sets = base.join(members.withColumn("kept", by_band), "key").select("key", "text", "kept", "places")
    place = "struct<band: int, bucket: bigint, block: int, blocks: int>"
    sets = sets.mapInArrow(partial(_sets, gram), f"key long, kept array<long>, places array<{place}>, grams array<long>")
    # block i meets every block j >= i: its members go to (i, j) as the left side and to (j, i) as the right one
    sent = F.flatten(
        F.transform(
            "places",
            lambda p: F.transform(
                F.sequence(F.lit(0), p["blocks"] - 1),
                lambda j: F.struct(p["band"].alias("band"), p["bucket"].alias("bucket"), F.least(p["block"], j).alias("left"), F.greatest(p["block"], j).alias("right"), (p["block"] > j).cast("int").alias("side")),
            ),
        )
    )
    dealt = sets.select("key", "kept", "grams", F.explode(sent).alias("s")).select("s.band", "s.bucket", "s.left", "s.right", "key", "s.side", "kept", "grams")
    met = cut(
        dealt.repartition(n, "band", "bucket", "left", "right")
        .sortWithinPartitions("band", "bucket", "left", "right", "key")
        .mapInArrow(partial(_verify, similarity), "key long, links long, least long")
    )
    links = met.groupBy("key").agg(F.sum("links").alias("n_links")).withColumnRenamed("key", "l_key")
    roots = components(met.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
    # what is known of each set, one row for each; then every document gets that of its set
    sets = cut(copies.join(links, F.col("copy_key") == F.col("l_key"), "left").join(roots, F.col("copy_key") == F.col("node"), "left"))
    sets = sets.select("d1", "d2", "n", "copies", "copy_key", F.coalesce("root", "copy_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    columns = ["key", "doc_id", "class_key", "copy_key", "n_links"]
    found = join_copies(signed.where("n > 0").drop("bands"), sets, ["d1", "d2", "n"], "copies").select(*columns)
    alone = signed.where("n = 0").select("key", "doc_id", F.col("key").alias("class_key"), F.col("key").alias("copy_key"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("class_key").alias("class_id"), F.col("copy_key").alias("copy_of"), "n_links")
