"""Operator 8: mixing sources to target weights by systematic sampling, in built-in functions only.

Sizes are words.  Targets: all sources share ``share`` times all words by weight, a target stops at
``limit`` times its source's size, and the excess is shared again by weight until none is above; this is
one level L with target = least(limit * size, L * weight), found from prefix sums over the sources.

Each document of a source expects target / size copies.  The expected copies are prefix-summed in the
order (size class, salt, doc_id, digest), one offset that depends on the source is added, and a document is
emitted once for each integer the sum crosses.  Documents of like size are neighbours, so the words
taken stay within about one document of the target.  The prefix sum is built from counts by
size class and by salt, so a hot source, or a hot group of copies, is never in one task.  Salt and
digest come from a hash of id and text together: ids in steps, or one id for many rows, are spread as
well, and the order, and with it the result, is the same in every run (rows of one place in it are equal).

Cases: null text has no words and size 0; a null source is a source by itself, last in order; rows that share a
doc_id are documents of their own; a source without words has target 0; an empty table gives an
empty result; other columns are ignored by ``mix`` and carried along by ``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, keyed_rows, table

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0


def size_class(size: Column) -> Column:
    """Sixteen classes for each power of two; 0 for 0."""
    digits = F.length(F.bin(size))
    return F.when(size == 0, 0).otherwise(digits * 16 + F.call_function("shiftright", size * 32, digits) - 16).cast("int")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target, rate) from (source, size): one row for each source.

    The two windows without a partition run over one row for each source, after the sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("double")).withColumn("cap", limit * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(share * F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levels.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the source and the seed only."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, size, digest and more) with source_size, target and copies; ``key``, if there, settles what is left of ties."""
    salt = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")
    docs = docs.withColumn("class", size_class(F.col("size"))).withColumn("salt", salt)
    cells = docs.groupBy("source", "class", "salt").agg(F.count("*").alias("n"))
    in_class = Window.partitionBy("source", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    before_class = classes.select("source", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before_class"))
    before = cells.withColumn("before_cell", F.coalesce(F.sum("n").over(in_class), F.lit(0))).drop("n")
    place = before.alias("a").join(before_class.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class")))
    place = place.select(F.col("a.source").alias("p_source"), F.col("a.class").alias("p_class"), F.col("a.salt").alias("p_salt"), (F.col("before_cell") + F.col("before_class")).alias("before"))
    targets = source_targets(docs, weights, share, limit).withColumnRenamed("source", "t_source")
    in_cell = Window.partitionBy("source", "class", "salt").orderBy("doc_id", "digest", *(["key"] if "key" in docs.columns else []))
    ranked = docs.withColumn("k", F.row_number().over(in_cell))
    found = ranked.join(place, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class")) & (F.col("salt") == F.col("p_salt")))
    found = found.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    k, u = F.col("k") + F.col("before"), offset(F.col("source"), seed)
    crossed = F.floor(F.col("rate") * k + u) - F.floor(F.col("rate") * (k - 1) + u)
    return found.withColumn("copies", F.least(crossed, F.lit(int(limit))).cast("long")).drop(
        "class", "salt", "digest", "k", "before", "p_source", "p_class", "p_salt", "t_source", "rate"
    )


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, digest, *more), written once: the texts are read only here."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("digest"), *more))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; taken: the words of all its copies."""
    found = copies(sized(docs), weights, share, limit, seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it."""
    base = keyed_rows(docs)
    with_source = base.select("key", "doc_id", "text", F.col("row")["source"].alias("source"), "row")
    taken = copies(sized(with_source, "key"), weights, share, limit, seed).where("copies > 0").select("key", "copies")
    return base.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(concat_ws(':', doc_id::VARCHAR, text)) AS digest FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_value(3, 1, 2)[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    ((SELECT sum(1.5::DOUBLE * source_size) FROM sources) - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
      / ((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (SELECT arg_min(level, ratio) AS l FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, l * weight) END AS target,
    ('0x' || substr(md5('mix' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM levels LEFT JOIN chosen ON true
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN size = 0 THEN 0 ELSE len(bin(size)) * 16 + ((size * 32) >> len(bin(size))) - 16 END, substr(digest, 1, 2), doc_id NULLS FIRST, digest) AS k
  FROM sizes
)
SELECT doc_id, size, source_size, target,
  (least(floor(target / source_size * k + u) - floor(target / source_size * (k - 1) + u), 2) * size)::BIGINT AS taken
FROM ordered JOIN targets ON ordered.source IS NOT DISTINCT FROM targets.source
"""
