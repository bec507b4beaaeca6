"""Queries of stored records, detector tables and writers: rows made from whole tables go through the operator, or a file, and back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.detect import detect, exploded, suggestions
from ..operators.redact import redact_detected
from ..operators.teach import check_regex, compile_detectors, template_to_regex
from ..sources import readers, sinks
from ..sources.readers import spread, table
from ..sources.store import shared_dir
from .detection import _SUGGEST, CARDS, REDACTED
from .registry import query
from .reports import audit_log
from .texts import KEY, LINES


def _path(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("a02_read_records", "SELECT 'https://c' || c_custkey AS origin, c_custkey % 4 AS stickers, CASE WHEN c_custkey % 4 > 0 THEN upper(c_mktsegment) END AS label FROM customer WHERE c_custkey % 5 > 0")
def a02_read_records(spark, sf_dir):
    """A site record for each customer as JSON lines, of version 1, or of 2 for each fifth one; the reader keeps version 1."""
    sticker = F.struct(F.concat(F.lit("s"), F.col("c_custkey")).alias("id"), F.upper("c_mktsegment").alias("label"), F.lit("unknown field").alias("note"))
    made = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 5 == 0, 2).otherwise(1).alias("v"), F.concat(F.lit("https://c"), F.col("c_custkey")).alias("origin"),
        F.array_repeat(sticker, (F.col("c_custkey") % 4).cast("int")).alias("stickers"),
    )
    path = _path(spark)
    made.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    found = readers.read_records(spark, path)
    return found.select("origin", F.size("stickers").cast("long").alias("stickers"), F.try_element_at("stickers", F.lit(1))["label"].alias("label"))


@query(
    "a03_clean_detectors",
    """WITH d AS (SELECT o_custkey AS list_id, o_orderkey AS place, o_orderkey % 7 AS r, 'd' || o_orderkey % 60 AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders),
    v AS (SELECT *, row_number() OVER (PARTITION BY list_id, id ORDER BY place) AS n FROM d WHERE r > 0 AND id <> 'd59'),
    w AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY place DESC) AS newest FROM v WHERE n = 1)
    SELECT list_id, place, id, CASE WHEN r = 1 THEN 'Custom pattern' ELSE 'Order ' || s END AS name, CASE WHEN r = 2 THEN 'regex' ELSE 'example' END AS source, CASE WHEN r = 3 THEN 'iu' END AS flags,
    trim(regexp_replace(lower(p), '[^a-z]+', ' ', 'g')) AS label, CASE s WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS strength, 'https://o' AS origin FROM w WHERE newest <= 50""",
)
def a03_clean_detectors(spark, sf_dir):
    """A user's detector for each order, in a list for each customer: ids that come twice, empty patterns and names, and values that are not known."""
    r = F.col("o_orderkey") % 7
    made = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("place"), F.expr("if(o_orderkey % 60 = 59, 'no id', concat('d', o_orderkey % 60))").alias("id"),
        F.when(r == 0, "").otherwise(r"\d{6}").alias("regex"), F.when(r == 1, "   ").otherwise(F.concat(F.lit(" Order \t "), "o_orderstatus")).alias("name"),
        F.when(r == 2, "regex").otherwise("unheard of").alias("source"), F.when(r == 3, "iu").otherwise("g").alias("flags"), F.array(F.col("o_orderpriority"), F.lit("12")).alias("labels"),
        F.expr("case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'utmost' end").alias("strength"), F.lit("https://o").alias("origin"), F.lit(None).cast("long").alias("createdAt"),
    )
    return A.clean_detectors(made, "site").select("list_id", "place", "id", "name", "source", "flags", F.array_join("labels", "|").alias("label"), "strength", "origin")


@query("a04_clean_toggles", "SELECT o_orderkey, 'e' || o_custkey AS entry, o_orderkey % 2 = 0 AS is_on FROM orders WHERE o_orderkey % 3 > 0")
def a04_clean_toggles(spark, sf_dir):
    """Toggles of each order: one good entry, at times without a value, and two keys that are none."""
    orders = table(spark, sf_dir, "orders")
    on = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 2 == 0)
    given = F.create_map(F.concat(F.lit("e"), "o_custkey"), on, F.concat(F.lit("E "), "o_custkey"), F.lit(True), F.repeat(F.lit("x"), 41), F.lit(True))
    return orders.select("o_orderkey", F.explode(A.clean_toggles(given)).alias("entry", "is_on"))


@query(
    "a05_write_hits",
    f"WITH hits AS (SELECT doc_key, block_id, {_SUGGEST} AS id FROM {LINES} WHERE len({CARDS}) > 0) SELECT doc_key, id, 'card' AS pattern, 3 AS score, row_number() OVER (PARTITION BY doc_key ORDER BY block_id)::INT AS place FROM hits",
)
def a05_write_hits(spark, sf_dir):
    """Hits of all documents written as identities and read back."""
    hits = exploded(detect(readers.read_documents(spark, sf_dir))).withColumn("label", F.lit(None).cast("string"))
    path = _path(spark)
    sinks.write_hits(suggestions(hits, spark.createDataFrame([], "id string"), KEY), path)
    return spark.read.schema("doc_key string, id string, name string, score int, place int, total long, pattern string").parquet(path).select("doc_key", "id", "pattern", "score", "place")


@query("a05_write_redacted", f"SELECT doc_key, block_id, {REDACTED} AS redacted, len({CARDS})::INT AS n_hits FROM {LINES}")
def a05_write_redacted(spark, sf_dir):
    path = _path(spark)
    sinks.write_redacted(redact_detected(readers.read_documents(spark, sf_dir)), path)
    return spark.read.schema("doc_key string, block_id int, redacted string, n_hits int").parquet(path)


@query(
    "a05_write_audit",
    "SELECT (epoch_us(ts) // 1000)::BIGINT AS ts, action, repeat('u', user_id % 250 - greatest(user_id % 250 - 200, 0)) AS origin FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'session-start' WHEN 'purchase' THEN 'session-end' WHEN 'error' THEN 'unlock-refused' WHEN 'click' THEN 'auto-lock' WHEN 'view' THEN 'auto-unlock' END AS action FROM events) WHERE action IS NOT NULL AND event_id % 10 > 0",
)
def a05_write_audit(spark, sf_dir):
    """All events as audit rows, every tenth of an action that is not known, origins of up to 250 characters; written and read back."""
    log = audit_log(spark, sf_dir).withColumn("action", F.when(F.col("event_id") % 10 == 0, "made-up").otherwise(F.col("action")))
    log = log.withColumn("origin", F.expr("repeat('u', cast(user_id % 250 as int))")).withColumn("reason", F.lit(None).cast("string"))
    path = _path(spark)
    sinks.write_audit(log, path)
    return spark.read.schema("ts long, origin string, reason string, action string").parquet(path).select("ts", "action", "origin")


def _invoices(spark, sf_dir):
    """A line for each order: its number in the form that its customer's nation would use, or in none."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.expr("concat('Invoice ', if(c_nationkey % 2 = 0, 'NA', 'NB'), lpad(cast(c_nationkey as string), 2, '0'), '-', lpad(cast(o_orderkey as string), 10, '0'), ' paid')")
    return joined.select(F.col("o_orderkey").cast("string").alias("doc_key"), F.lit(0).alias("block_id"), "c_nationkey", text.alias("text"))


_VALUE = "'NA' || lpad(c_nationkey::VARCHAR, 2, '0') || '-' || lpad(o_orderkey::VARCHAR, 10, '0')"


@query("s06_template_matches", f"SELECT o_orderkey::VARCHAR AS doc_key, 8 AS start, {_VALUE} AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0")
def s06_template_matches(spark, sf_dir):
    r"""A user's template, two letters fixed and digits of any value, over a line for each order."""
    from ..operators import detectors as D

    det = D.custom("invoice", "Invoice", template_to_regex(r"\N\A##-#*"), None, ["invoice"], "high")
    found = exploded_spans(detect(_invoices(spark, sf_dir), detectors=[det], keep="all"))
    return found.select("doc_key", "start", "value")


def exploded_spans(found):
    """(doc_key, pattern, start, value) of every hit."""
    hits = found.select("doc_key", "text", F.explode_outer("hits").alias("h")).where("h is not null")
    return hits.select("doc_key", "h.pattern", "h.start", F.substring("text", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("value"))


def _taught(spark, sf_dir):
    """A detector for each nation as users teach them: a good one for even numbers, for odd ones a pattern that is refused."""
    bad = r"element_at(array('(a+)+b', 'NB0[0-9]*[0-9]*-', '(NB)-\\1', 'NB1234'), cast(n_nationkey div 2 % 4 as int) + 1)"
    regex = rf"if(n_nationkey % 2 = 0, concat('\\bNA', lpad(cast(n_nationkey as string), 2, '0'), '-[0-9]{{10}}\\b'), {bad})"
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.expr(regex).alias("regex"), F.lit(None).cast("string").alias("flags"), F.array(F.lit("invoice")).alias("labels"), F.lit("low").alias("strength"))


@query("s08_compiled_matches", f"SELECT o_orderkey::VARCHAR AS doc_key, 'custom:n' || c_nationkey AS pattern, 8 AS start, {_VALUE} AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0")
def s08_compiled_matches(spark, sf_dir):
    """A table of taught detectors compiled and run over a line for each order; weak ones, so it is the label that lets them in."""
    return exploded_spans(detect(_invoices(spark, sf_dir), detectors=compile_detectors(_taught(spark, sf_dir)), keep="all"))


@query("s07_checked_detectors", "SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def s07_checked_detectors(spark, sf_dir):
    """Every taught pattern's verdict; the table of detectors is bounded (fifty for a site), so it is checked on the driver."""
    rows = [(int(r.id[1:]), check_regex(r.regex, r.flags or "").ok) for r in _taught(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "n_nationkey long, ok boolean")
