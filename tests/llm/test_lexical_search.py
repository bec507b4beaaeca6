"""Ranked lexical search against a plain version, its bounds, and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veil.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 75 + (25 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, (d is not None, d or 0), d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=300):
    """Few frequent words in most documents, rare ones, copies (equal scores), long documents."""
    rng = random.Random(seed)
    frequent = [f"f{i}" for i in range(12)]
    rare = [f"Réf{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        words = rng.choices(frequent, range(1, 13), k=rng.randint(1, 60)) + rng.choices(rare, k=rng.randint(0, 12))
        rng.shuffle(words)
        texts.append(rng.choice(texts) if texts and rng.random() < 0.2 else rng.choice([" ", "-", "\n"]).join(words))
    texts += ["f1 " * 5000, "", "  ... ", "F2F2 É É É"]
    items = [" ".join(rng.choices(frequent, k=rng.randint(1, 9)) + rng.choices(rare, k=rng.randint(0, 4))) for _ in range(25)]
    return list(enumerate(texts)), list(enumerate(items + ["", "no such terms", "f1 f1 f1 F2"]))


def frames(spark, docs, items):
    d = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in docs], "doc_id long, text string, term string, segment int, score int")
    return d, spark.createDataFrame([(a, b, 3) for a, b in items], "item_id long, text string, rank int")


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("segment_docs, k, pairs", [(16, 20, 12), (1 << 14, 5, 3), (40, 20, 0)])
def test_same_as_plain(spark, monkeypatch, segment_docs, k, pairs):
    monkeypatch.setattr(L, "SEGMENT_DOCS", segment_docs)
    docs, items = corpus(segment_docs)
    d, i = frames(spark, docs, items)
    assert rows(L.search(L.build_index(d.repartition(3), pairs), i, k)) == plain(docs, items, k)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ITEMS", 7)
    docs, items = corpus(9, 60)
    d, i = frames(spark, docs, items)
    assert rows(L.search(L.build_index(d), i)) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(None, "one two"), (3, "one two"), (3, "one two"), (-5, "one two"), (4, None), (5, "one " * 40_000)]
    items = [(None, "one"), (1, "two two"), (1, "one two"), (2, None)]
    d, i = frames(spark, docs, items)
    found = rows(L.search(L.build_index(d), i))
    assert found == plain(docs, items)
    # equal scores: no id first, then ascending, and every row that shares an id
    assert [r[2] for r in sorted(found, key=lambda r: r[1]) if r[0] is None] == [5, None, -5, 3, 3]


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b")], [(1, "a")])
    assert rows(L.search(L.build_index(d.limit(0)), i)) == []
    assert rows(L.search(L.build_index(d), i.limit(0))) == []
    assert rows(L.search(L.build_index(d.selectExpr("doc_id", "'. -' as text")), i)) == []


def segment_of(docs, frequent):
    """One segment in memory, with its totals."""
    import pyarrow as pa

    given = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t.encode() for _, t in docs], pa.binary())], ["doc_id", "text"])
    (batch,) = L._segments(iter([given]))
    totals = batch.column("n_docs")[0].as_py(), batch.column("n_terms")[0].as_py()
    df = dict(zip(batch.column("terms")[0].as_py(), batch.column("counts")[0].as_py()))
    weights = {t: L.weight(totals[0], n) for t, n in df.items()}
    (paired,) = L._pairs({t: weights[t] for t in frequent}, totals)(iter([batch]))
    row, terms = L._row(paired, 0)
    return L.Segment(row, terms, totals, weights), L.Pairs(row, frequent, totals[0])


def test_pairs_are_exact_and_bounds_hold():
    docs, items = corpus(4)
    frequent = [f"f{i}" for i in range(12)]
    segment, pairs = segment_of(docs, frequent)
    dense = defaultdict(lambda: np.zeros(len(segment.doc_ids), np.int64))
    for t, (held, adds, _) in segment.postings.items():
        dense[t][held] = adds
    for i, a in enumerate(frequent):
        for b in frequent[i + 1 :]:
            both = (dense[a] > 0) & (dense[b] > 0)
            number = pairs.number(b, a)
            assert pairs.joint[number] == np.where(both, dense[a] + dense[b], 0).max()
            assert (pairs.holds(number, np.arange(len(both))) == both).all()
    tighter = 0
    for _, text in items:
        query = Counter(t for t in plain_terms(text) if t in segment.postings)
        bound, singles = L.Bound(pairs), 0
        for t, n in query.items():
            bound.add(t, n, n * segment.postings[t][2])
            singles += n * segment.postings[t][2]
        scores = sum((n * dense[t] for t, n in query.items()), np.zeros(len(segment.doc_ids), np.int64))
        assert bound.total >= scores.max() and bound.total <= singles
        of = bound.of(np.arange(len(scores)))
        assert (of >= scores).all() and (of <= bound.total).all()
        tighter += bound.total < singles
    assert tighter > len(items) // 2


def test_pair_bounds_skip_more():
    docs, items = corpus(7, 2000)
    frequent = [f"f{i}" for i in range(12)]
    segment, pairs = segment_of(docs, frequent)
    _, without = segment_of(docs, [])
    with_pairs, alone = {}, {}
    for _, text in items:
        query = Counter(plain_terms(text))
        a = L.best_of(segment, pairs, query, 5, 0, with_pairs)
        b = L.best_of(segment, without, query, 5, 0, alone)
        top = lambda r: sorted(zip((-r[1]).tolist(), r[0].tolist()))[:5]
        assert top(a) == top(b)
    assert with_pairs["skipped"] > alone["skipped"] > 0
