"""Operator 6: base rules and a hashed n-gram log-likelihood ratio, in built-in functions only.

Words and neighbouring word pairs are hashed to ``buckets`` classes.  Two multinomials over the
classes are counted: one of the trusted target (documents whose label has quality 1), one of all
documents.  A document's score is the sum of log(target / raw) of its n-grams over their number; it is
kept if no base rule fails and the score reaches ``threshold``.  The ratios are one array of fixed
size, read by a scalar subquery, so that scoring is a projection.

Cases: null text has no words, so a base rule fails; a row without doc_id is scored but cannot be in
the target; repeated rows are scored one by one and count each; labels may repeat; without any target
only the base rules decide; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16
SMOOTH = 1.0
#: Mean log ratio of an n-gram below which a document is not like the target.
THRESHOLD = -0.12
#: Labelled ids up to which they are sent to every task; more are joined by a shuffle.
SEND = 1_000_000

_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _grams(buckets: int) -> Column:
    """Classes of the words and word pairs of an array of word hashes ``h``."""
    pairs = F.expr("if(size(h) > 1, transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])), array())")
    return F.transform(F.concat(F.col("h"), pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> DataFrame:
    """One row: ``ratios``, the log ratio of each class in order, or null if nothing is in the target."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    if trusted.limit(SEND + 1).count() <= SEND:
        trusted = F.broadcast(trusted)
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(trusted.withColumn("target", F.lit(1)), "doc_id", "left")
    hashed = marked.select(F.coalesce("target", F.lit(0)).alias("target"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    counts = (
        hashed.select("target", F.explode(_grams(buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("target").alias("t"), F.count("*").alias("r"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    return full.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"), F.sum("t").alias("tt"), F.sum("r").alias("rr")
    ).select(
        F.when(
            F.col("tt") > 0,
            F.expr(f"transform(c, x -> ln((x.t + {smooth}) / (tt + {smooth * buckets})) - ln((x.r + {smooth}) / (rr + {smooth * buckets})))"),
        ).alias("ratios")
    )


#: Words covered by 5-word windows that are found twice or more. Most documents have none, which the
#: number of distinct hashes shows; of the others the hashes are sorted with their places.
_REPEATED = """
    case when size(five) = size(array_distinct(five)) then 0L else
      aggregate(
        array_sort(transform(
          array(array_sort(transform(five, (x, i) -> named_struct('h', x, 'i', cast(i as bigint))))),
          s -> filter(
            transform(s, (x, j) -> if((j > 0 and s[j - 1].h = x.h) or (j + 1 < size(s) and s[j + 1].h = x.h), x.i, -1L)),
            p -> p >= 0)
        )[0]),
        named_struct('stop', 0L, 'total', 0L),
        (a, p) -> named_struct('stop', p + 5, 'total', a.total + p + 5 - greatest(a.stop, p)),
        a -> a.total)
    end
"""


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row."""
    ratios = log_ratios(docs, labels, buckets, smooth)
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"))
    counted = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    ready = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(h) > 4, transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])), cast(array() as array<bigint>))").alias("five"),
        _grams(buckets).alias("grams"),
        ratios.scalar().alias("ratios"),
    )
    scored = ready.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(_REPEATED).alias("n_repeat_words"),
        F.expr("try_divide(aggregate(grams, 0D, (a, g) -> a + ratios[g]), size(grams))").alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.coalesce("score", F.lit(0.0)) >= threshold)).alias("kept"), "score",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
