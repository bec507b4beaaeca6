"""The hit report: merged counts, merged sketches, and what it does with odd rows."""

import itertools

from pyspark.sql import functions as F

from veil.operators.audit import hit_report

SCHEMA = "source string, pattern string, strength string, doc_key string"


def plain(rows):
    """Counts of every subtotal, one hit at a time."""
    n, docs = {}, {}
    for *leaf, doc in rows:
        for kept in itertools.product([True, False], repeat=3):
            cell = (*(x if k else None for x, k in zip(leaf, kept, strict=True)), sum((not k) << (2 - i) for i, k in enumerate(kept)))
            n[cell] = n.get(cell, 0) + 1
            docs.setdefault(cell, set()).update({doc} - {None})
    return sorted(((*c[:3], n[c], len(docs[c]), c[3]) for c in n), key=repr)


def test_subtotals_of_odd_rows(spark):
    """Null sources, patterns and documents, one document with most hits, documents in many leaves."""
    rows = [("a", "card", "high", "d1")] * 50 + [("a", "ssn", "high", "d1"), ("b", "card", "low", "d1"), (None, "card", "high", "d2"), (None, None, None, None), ("b", "card", "low", None), ("b", "", "low", "")]
    hits = spark.createDataFrame(rows, SCHEMA)
    for report in (hit_report(hits), hit_report(hits, log_k=12)):
        assert sorted(map(tuple, report.collect()), key=repr) == plain(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert hit_report(none).count() == 0 and hit_report(none, 12).count() == 0


def test_sketches_keep_their_error(spark):
    hits = spark.range(300_000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("card").alias("pattern"), F.lit("high").alias("strength"), (F.col("id") % 100_000).cast("string").alias("doc_key"))
    for r in hit_report(hits, log_k=12).collect():
        exact = 100_000  # ids differ by multiples of 100,000, which leave other remainders by three
        assert r.n in (100_000, 300_000) and abs(r.docs - exact) <= 0.05 * exact


def test_hits_are_counted_before_subtotals(spark):
    """The copies for subtotals are made of leaves: below the one Expand there is an aggregate of hits."""
    hits = spark.range(10).selectExpr("'s' as source", "'p' as pattern", "'h' as strength", "cast(id as string) as doc_key")
    for report in (hit_report(hits), hit_report(hits, log_k=12)):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Expand") == 1 and "Aggregate" in plan[plan.index("Expand") :]
