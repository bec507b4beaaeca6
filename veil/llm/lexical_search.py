"""Operator 11: ranked lexical search by pair-bound MaxScore.

The index is a table of *segments*, bounded runs of documents; each row holds the postings of all terms of its
documents.  Statistics over all segments (documents, terms, documents of each term) fix the weights.  For the
PAIR_TERMS terms that most documents hold, the ones that queries keep skipping, each segment also stores, for every pair, the list of
documents that hold both (a bit for each document) and the joint maximum impact in it.

A query takes its terms by falling maximum impact and adds postings to all documents, until what the rest can add
is below the score of the k-th document so far: then only documents already met go on, and each is dropped as
soon as its own bound falls below.  The bound of the rest is not the sum of its terms' maxima: frequent terms are
matched in pairs, and a pair adds at most its joint maximum, or, for a document outside its list, the larger of
the two maxima.  Documents with an equal score are never skipped, so the result is exact.

A task keeps the k best of each query over its segments, so that the score to beat carries over; the tasks' best are
merged by query.  Queries are sent to the tasks in blocks of bounded size.

Cases: null and empty texts have no terms and are not counted as documents; a query without terms, with null text or
without matches gives no rows; queries that share an item_id are ranked apart; rows that share a doc_id are
separate documents; a null doc_id sorts first among equal scores; very long documents are segments by themselves; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, parts, small_batches, table

#: Results of a query.
TOP = 20
#: Bytes of text and documents of one segment, at most; a longer document is one by itself.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 1 << 14
#: Frequent terms whose pairs have lists.
PAIR_TERMS = 48
#: Queries, and terms of queries, that are sent to the tasks at once.
BLOCK_ITEMS, BLOCK_TERMS = 2048, 1 << 18

#: ASCII letters and digits, lower-cased, and all bytes of other characters; anything else ends a term.
_KEEP = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

SEGMENT = (
    "segment long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms array<string>, counts array<int>,"
    " docs binary, tfs binary"
)
INDEX = f"{SEGMENT}, joint binary, lists binary"
_NULL_ID = np.iinfo(np.int64).min


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents as postings, ordered by term and document."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    ids: list[int] = []
    lengths: list[int] = []
    distinct: list[int] = []
    size, vocabulary, places, tfs = 0, {}, [], []

    def done():
        which = np.concatenate(places)
        order = np.argsort(which, kind="stable")
        counts = np.bincount(which, minlength=len(vocabulary))
        docs = np.repeat(np.arange(len(ids), dtype="<u2"), distinct)[order]
        strings = pa.array([t.decode() for t in vocabulary], pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (strings, pa.array(counts, pa.int32()))]
        plain = [[number], [len(ids)], [sum(lengths)], [np.array(ids, "<i8").tobytes()], [np.array(lengths, "<i4").tobytes()]]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        columns = [pa.array(v, k) for v, k in zip(plain, kinds, strict=True)] + lists
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (docs, np.concatenate(tfs)[order])]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENT.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = Counter(terms_of(text))
            if not found:
                continue
            if ids and (size + len(text) > SEGMENT_BYTES or len(ids) == SEGMENT_DOCS):
                yield done()
                number += 1
                ids, lengths, distinct, size, vocabulary, places, tfs = [], [], [], 0, {}, [], []
            for term in found:
                vocabulary.setdefault(term, len(vocabulary))
            places.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            tfs.append(np.fromiter(found.values(), "<u4", len(found)))
            ids.append(_NULL_ID if doc_id is None else doc_id)
            lengths.append(found.total())
            distinct.append(len(found))
            size += len(text)
    if ids:
        yield done()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in a query adds for a document, but for the term's weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Segment:
    """A row of the index, with the impacts of the terms that some queries ask for."""

    def __init__(self, row: dict, terms: pa.Array, totals: tuple[int, int], weights: dict[str, int]):
        self.doc_ids, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        n_docs, n_terms = totals
        m = 75 + (25 * lengths * n_docs) // n_terms
        stops = np.cumsum(np.frombuffer(row["counts"], "<i4"), dtype=np.int64)
        docs, tfs = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["tfs"], "<u4")
        asked = pa.array(list(weights), pa.string())
        places = pc.index_in(asked, value_set=terms)
        self.postings: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for term, place in zip(weights, places.to_pylist(), strict=True):
            if place is not None and weights[term] > 0:
                a, b = stops[place - 1] if place else 0, stops[place]
                held = docs[a:b].astype(np.int64)
                adds = weights[term] * impact(tfs[a:b], m[held])
                self.postings[term] = held, adds, int(adds.max())


def _pairs(frequent: dict[str, int], totals: tuple[int, int]):
    """Segments with the joint maxima and the lists of all pairs of frequent terms (term: weight)."""
    p = len(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joints, lists = [], []
            for i in range(batch.num_rows):
                row, terms = _row(batch, i)
                segment = Segment(row, terms, totals, frequent)
                adds = np.zeros((p, len(segment.doc_ids)), np.int64)
                for k, term in enumerate(frequent):
                    if term in segment.postings:
                        held, values, _ = segment.postings[term]
                        adds[k, held] = values
                there = adds > 0
                joint, bits = [np.zeros(0, np.int64)], [np.zeros((0, -(-adds.shape[1] // 8)), np.uint8)]
                for k in range(p - 1):
                    both = there[k] & there[k + 1 :]
                    joint.append(np.where(both, adds[k] + adds[k + 1 :], 0).max(axis=1))
                    bits.append(np.packbits(both, axis=1))
                joints.append(np.concatenate(joint).astype("<i8").tobytes())
                lists.append(np.concatenate(bits).tobytes())
            extra = [pa.array(joints, pa.binary()), pa.array(lists, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "joint", "lists"])

    return run


def _row(batch: pa.RecordBatch, i: int) -> tuple[dict, pa.Array]:
    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c in ("doc_ids", "lengths", "docs", "tfs", "joint", "lists")}
    row["counts"] = np.asarray(batch.column("counts")[i].values, np.int32).astype("<i4").tobytes()
    return row, batch.column("terms")[i].values


class Pairs:
    """Joint maxima and lists of one segment."""

    def __init__(self, row: dict, names: list[str], n_docs: int):
        self.place = {t: i for i, t in enumerate(names)}
        self.p, self.width = len(names), -(-n_docs // 8)
        self.joint = np.frombuffer(row["joint"], "<i8")
        self.bits = np.frombuffer(row["lists"], np.uint8)

    def number(self, a: str, b: str) -> int:
        i, j = sorted((self.place[a], self.place[b]))
        return i * (2 * self.p - i - 1) // 2 + j - i - 1

    def holds(self, number: int, docs: np.ndarray) -> np.ndarray:
        """Which of the documents hold both terms."""
        found = self.bits[number * self.width + (docs >> 3)]
        return (found >> (7 - (docs & 7)).astype(np.uint8)) & 1 == 1


class Bound:
    """What a growing set of terms can add to one document: single maxima, and pairs with a joint maximum."""

    def __init__(self, pairs: Pairs):
        self.pairs, self.single, self.free, self.matched, self.total = pairs, 0, [], [], 0

    def add(self, term: str, times: int, most: int) -> None:
        """A term that the query has ``times`` times, with ``most`` for all of them."""
        best = None
        if term in self.pairs.place:
            for k, (other, other_times, other_most) in enumerate(self.free):
                number = self.pairs.number(term, other)
                both = min(times, other_times)
                joint = both * int(self.pairs.joint[number]) + (times - both) * (most // times) + (other_times - both) * (other_most // other_times)
                either = max(most, other_most)
                saved = most + other_most - max(min(joint, most + other_most), either)
                if best is None or saved > best[0]:
                    best = saved, k, number, min(joint, most + other_most), either
        if best is None or best[0] <= 0:
            if term in self.pairs.place:
                self.free.append((term, times, most))
            self.single += most
            self.total += most
            return
        saved, k, number, joint, either = best
        self.single -= self.free.pop(k)[2]
        self.matched.append((number, max(joint, either), either))
        self.total += most - saved

    def copy(self) -> Bound:
        other = Bound(self.pairs)
        other.single, other.free, other.matched, other.total = self.single, list(self.free), list(self.matched), self.total
        return other

    def of(self, docs: np.ndarray) -> np.ndarray:
        """For each document by itself."""
        out = np.full(len(docs), self.single, np.int64)
        for number, inside, outside in self.matched:
            out += np.where(self.pairs.holds(number, docs), inside, outside)
        return out


def best_of(segment: Segment, pairs: Pairs, query: Counter, k: int, floor: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of one segment that may be among the k best: all with at least ``floor`` that can be among
    the segment's own k, and no score of 0.  seen counts postings that were added and skipped."""
    terms = sorted(((segment.postings[t][2] * n, t, n) for t, n in query.items() if t in segment.postings), reverse=True)
    none = np.zeros(0, np.int64)
    if not terms:
        return none, none
    rest = [Bound(pairs)]
    for most, term, times in reversed(terms):
        bound = rest[-1].copy()
        bound.add(term, times, most)
        rest.append(bound)
    rest.reverse()  # rest[j]: the terms from j on
    floor = max(floor, 1)
    scores = np.zeros(len(segment.doc_ids), np.int64)
    met = at = 0
    while at < len(terms) and rest[at].total >= floor:
        _, term, times = terms[at]
        held, adds, _ = segment.postings[term]
        scores[held] += times * adds
        met += len(held)
        at += 1
        if met >= k and len(scores) > k:
            floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    docs = np.flatnonzero(scores) if at else none
    if seen is not None:
        seen["added"] = seen.get("added", 0) + met
        seen["skipped"] = seen.get("skipped", 0) + sum(len(segment.postings[t][0]) for _, t, _ in terms[at:])
    while at < len(terms) and len(docs):
        docs = docs[scores[docs] + rest[at].total >= floor] if not rest[at].matched else docs[scores[docs] + rest[at].of(docs) >= floor]
        _, term, times = terms[at]
        held, adds, _ = segment.postings[term]
        place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        scores[docs] += np.where(held[place] == docs, times * adds[place], 0)
        at += 1
        if len(docs) > k:
            floor = max(floor, int(np.partition(scores[docs], len(docs) - k)[len(docs) - k]))
    docs = docs[scores[docs] >= floor]
    return docs, scores[docs]


def _search(numbers: list[int], queries: list[Counter], weights: dict[str, int], frequent: list[str], totals: tuple[int, int], k: int):
    """The k best documents of each query over a task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [np.zeros(0, np.int64) for _ in queries]
        scores = [np.zeros(0, np.int64) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row, terms = _row(batch, i)
                segment = Segment(row, terms, totals, weights)
                pairs = Pairs(row, frequent, len(segment.doc_ids))
                for q, query in enumerate(queries):
                    floor = int(scores[q][-1]) if len(scores[q]) == k else 0
                    docs, found = best_of(segment, pairs, query, k, floor)
                    if len(docs):
                        d, s = np.concatenate([ids[q], segment.doc_ids[docs]]), np.concatenate([scores[q], found])
                        order = np.lexsort((d, -s))[:k]
                        ids[q], scores[q] = d[order], s[order]
        number, doc_id = np.repeat(np.array(numbers, np.int64), [len(x) for x in ids]), np.concatenate(ids)
        columns = [pa.array(number, pa.int64()), pa.array(doc_id, pa.int64(), mask=doc_id == _NULL_ID), pa.array(np.concatenate(scores), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return run


class Index:
    """Segments with pair lists, the documents of each term, and the totals."""

    def __init__(self, segments: DataFrame, vocabulary: DataFrame, frequent: list[str], n_docs: int, n_terms: int):
        self.segments, self.vocabulary, self.frequent, self.totals = segments, vocabulary, frequent, (n_docs, n_terms)


def build_index(docs: DataFrame, pair_terms: int = PAIR_TERMS) -> Index:
    """The index of docs (doc_id, text), written in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    postings = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_segments, SEGMENT))
    n_docs, n_terms = postings.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    each = postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("n"))
    vocabulary = cut(each.groupBy("term").agg(F.sum("n").alias("df")))
    top = vocabulary.orderBy(F.desc("df"), "term").limit(pair_terms).collect()
    totals = (n_docs or 0, n_terms or 0)
    weights = {r["term"]: weight(totals[0], r["df"]) for r in top}
    return Index(cut(postings.mapInArrow(_pairs(weights, totals), INDEX)), vocabulary, list(weights), *totals)


def blocks(queries: Iterable[tuple[int, str | None]]) -> Iterator[tuple[list[int], list[Counter]]]:
    """Numbered queries as counted terms, in blocks of bounded size."""
    numbers, held, size = [], [], 0
    for number, text in queries:
        counted = Counter(t.decode() for t in terms_of((text or "").encode()))
        if held and (len(held) == BLOCK_ITEMS or size + len(counted) > BLOCK_TERMS):
            yield numbers, held
            numbers, held, size = [], [], 0
        numbers.append(number)
        held.append(counted)
        size += len(counted)
    if held:
        yield numbers, held


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text)."""
    spark = index.segments.sparkSession
    small_batches(spark)
    given = cut(items.select("item_id", "text").orderBy("item_id", "text").withColumn("query", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    asked = ((r["query"], r["text"]) for r in given.select("query", "text").toLocalIterator())
    for numbers, queries in blocks(asked):
        terms = sorted(set().union(*queries))
        if not terms or not index.totals[0]:
            continue
        wanted = spark.createDataFrame([(t,) for t in terms], "term string")
        df = {r["term"]: r["df"] for r in index.vocabulary.join(F.broadcast(wanted), "term").collect()}
        weights = {t: weight(index.totals[0], df[t]) for t in terms if t in df}
        run = _search(numbers, queries, weights, index.frequent, index.totals, k)
        found = found.unionByName(index.segments.mapInArrow(run, "query long, doc_id long, score long"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    # first among some tasks' results, then among all
    some = Window.partitionBy("query", "group").orderBy(*order)
    found = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(parts(spark))))
    found = found.withColumn("place", F.row_number().over(some)).where(F.col("place") <= k).drop("place", "group")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return found.join(given.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT d, doc_id, len(terms)::BIGINT AS n, terms FROM words WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs
), tfs AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term
), dfs AS (
  SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term
), items AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), asked AS (
  SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY q, item_id, term
), weighed AS (
  SELECT q, item_id, term, times, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term), totals
), scored AS (
  SELECT q, item_id, doc_id, d,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN docs USING (d), totals GROUP BY q, item_id, doc_id, d
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 20
"""
