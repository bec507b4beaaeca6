"""Queries of audits and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.detect import detect, exploded
from ..operators.detectors import BUILTIN, CATALOG
from ..operators.redact import redact_detected
from ..operators.teach import describe_units, derive_from_example, shape_of, strength_of, units_to_regex
from ..operators.windows import token_hmacs
from ..sources import readers
from ..sources.readers import table
from .detection import CARDS, REDACTED
from .registry import query
from .texts import KEY, LINES

_WITH_EMAIL = (*BUILTIN, *[d for d in CATALOG if d.id == "email"])
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"
AUDIT = "(SELECT (epoch_us(ts) // 1000)::BIGINT AS ts, CASE event_type WHEN 'signup' THEN 'session-start' WHEN 'purchase' THEN 'session-end' WHEN 'error' THEN 'unlock-refused' WHEN 'click' THEN 'auto-lock' WHEN 'view' THEN 'auto-unlock' END AS action, user_id, event_id FROM events)"


def audit_log(spark, sf_dir):
    """The events table as audit rows: user_id stands for the tab."""
    actions = {"signup": "session-start", "purchase": "session-end", "error": "unlock-refused", "click": "auto-lock", "view": "auto-unlock"}
    action = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), action.alias("action"), "user_id", "event_id")


def redacted_leaks(blocks):
    """(id, path, pattern) for every block (doc_key, block_id, text) whose redacted text still has a leak."""
    redacted = redact_detected(blocks).select(F.concat_ws(":", "doc_key", "block_id").alias("id"), "redacted")
    return A.leak_audit(redacted, "id")


@query(
    "g01_leak_audit",
    "WITH s AS (SELECT c_custkey AS id, unnest([{'path': 'c_name', 'v': c_name}, {'path': 'c_phone', 'v': 'tel ' || lpad(cast(c_custkey * 104729 AS varchar), 9, '0')}, {'path': 'tags[]', 'v': lpad(cast(c_custkey % 100 AS varchar), 2, '0') || '-' || lpad(cast(c_custkey * 31 AS varchar), 7, '0')}]) AS f FROM customer)"
    " SELECT id, f.path AS path, CASE WHEN regexp_matches(f.v, '(?:^|[^0-9A-Za-z_])[0-9]{2}-[0-9]{7}(?:$|[^0-9A-Za-z_])') THEN 'ein' WHEN regexp_matches(f.v, '(?:^|[^0-9A-Za-z_])[0-9]{9,}(?:$|[^0-9A-Za-z_])') THEN 'long number' END AS pattern FROM s WHERE pattern IS NOT NULL",
)
def g01_leak_audit(spark, sf_dir):
    made = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name", "concat('tel ', lpad(cast(c_custkey * 104729 as string), 9, '0')) as c_phone", "array(concat(lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey * 31 as string), 7, '0'))) as tags")
    return A.leak_audit(made, "id")


@query("a06_guarded_rows", "SELECT c_custkey AS id, length(cast(c_custkey * 104729 AS varchar)) < 9 AS stored FROM customer")
def a06_guarded_rows(spark, sf_dir):
    made = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as id", "concat('tel ', cast(c_custkey * 104729 as string)) as phone")
    stored, dropped = A.guarded(made, "id")
    return stored.select("id", F.lit(True).alias("stored")).unionByName(dropped.select("id", F.lit(False).alias("stored")))


# the leak patterns over the redacted text; this dialect's word boundary is that of ASCII, too
_LEFT = rf"""(SELECT CASE WHEN regexp_matches(r, '\b[0-9]{{3}}[- ][0-9]{{2}}[- ][0-9]{{4}}\b') THEN 'ssn' WHEN regexp_matches(r, '\b[0-9]{{2}}-[0-9]{{7}}\b') THEN 'ein'
    WHEN regexp_matches(r, '\b[0-9]{{9,}}\b') THEN 'long number' WHEN regexp_matches(r, '\b(?:[0-9][ -]?){{13,19}}\b') THEN 'card' END AS pattern FROM (SELECT {REDACTED} AS r FROM {LINES}))"""


@query("g01_redacted_is_clean", f"SELECT count(pattern) AS leaks FROM {_LEFT}")
def g01_redacted_is_clean(spark, sf_dir):
    """How many redacted blocks still show something that looks like an identifier: numbers that no detector accepts."""
    return redacted_leaks(readers.read_documents(spark, sf_dir)).agg(F.count("*").alias("leaks"))


@query("g01_redacted_leaks", f"SELECT pattern, count(*) AS leaks FROM {_LEFT} WHERE pattern IS NOT NULL GROUP BY pattern")
def g01_redacted_leaks(spark, sf_dir):
    """What redaction leaves, by leak pattern."""
    return redacted_leaks(readers.read_documents(spark, sf_dir)).groupBy("pattern").agg(F.count("*").alias("leaks"))


@query(
    "g02_secret_scan",
    rf"""WITH l AS (SELECT doc_key AS path, block_id AS line_no, text FROM {LINES})
    SELECT path, line_no, 'hex secret' AS kind, substr(unnest(regexp_extract_all(text, '(?i)(?:key|token|secret)[A-Za-z0-9_-]*["'']?\s*[:=]?\s*["'']?[0-9a-f]{{32,}}')), 1, 12) || '...' AS shown FROM l
    UNION ALL SELECT path, line_no, 'email', m FROM (SELECT path, line_no, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS m FROM l) WHERE NOT regexp_matches(m, '(?i)@(?:users\.noreply\.github\.com|example\.(?:com|org|net)|[A-Za-z0-9_.-]+\.(?:example|test|invalid|localhost))$')""",
)
def g02_secret_scan(spark, sf_dir):
    lines = readers.read_documents(spark, sf_dir).select(F.col("doc_key").alias("path"), F.col("block_id").alias("line_no"), "text")
    return A.secret_scan(lines)


@query("g03_scan_stats", f"SELECT doc_key, count(*) AS blocks, count(*) FILTER (len(regexp_replace(text, '[^0-9]', '', 'g')) >= 4) AS candidates, false AS truncated, count(*) FILTER (len({CARDS}) > 0) AS detections FROM {LINES} GROUP BY doc_key")
def g03_scan_stats(spark, sf_dir):
    blocks = readers.read_documents(spark, sf_dir)
    return A.scan_stats(blocks, exploded(detect(blocks)))


_BY_LINE = LINES.replace("SELECT CAST(doc_id", "SELECT source, CAST(doc_id").replace("SELECT doc_id, string_split", "SELECT source, doc_id, string_split")


@query(
    "g04_hit_report",
    f"WITH h AS (SELECT source, doc_key, 'card' AS pattern, unnest({CARDS}) AS value FROM {_BY_LINE} UNION ALL SELECT source, doc_key, 'catalog:email', unnest(regexp_extract_all(text, '{_EMAIL}')) FROM {_BY_LINE}) SELECT source, pattern, strength, count(*) AS n, count(DISTINCT doc_key) AS docs, grouping_id(source, pattern, strength)::BIGINT AS level FROM (SELECT *, 'high' AS strength FROM h) GROUP BY CUBE (source, pattern, strength)",
)
def g04_hit_report(spark, sf_dir):
    """Hits of all built-in detectors and of the catalogue's for emails, in all documents."""
    docs = readers.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    blocks = docs.select(F.col("doc_id").cast("string").alias("doc_key"), "source", F.posexplode(F.split("text", "\n")).alias("block_id", "text"))
    found = detect(blocks, detectors=_WITH_EMAIL, keep="all").select("doc_key", "source", F.explode_outer("hits").alias("h"))
    return A.hit_report(found.where("h is not null").select("doc_key", "source", "h.pattern", "h.strength"))


@query("g05_coverage_report", "SELECT page_id, count(*) FILTER (state = 'lost') AS lost, count(*) FILTER (state = 'attached') AS attached, count(*) FILTER (state = 'backstop') AS backstop, min(sticker_id) FILTER (state = 'lost') AS first_lost FROM (SELECT l_orderkey AS page_id, l_linenumber AS sticker_id, (['lost', 'attached', 'backstop'])[l_partkey % 3 + 1] AS state FROM lineitem) GROUP BY page_id")
def g05_coverage_report(spark, sf_dir):
    states = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page_id", "l_linenumber as sticker_id", "element_at(array('lost', 'attached', 'backstop'), cast(l_partkey % 3 as int) + 1) as state")
    return A.coverage_report(states)


@query("g06_audit_summary", f"SELECT action, cast(user_id % 10 AS varchar) AS origin, count(*) AS n, max(ts) AS latest FROM {AUDIT} WHERE action IS NOT NULL GROUP BY ALL")
def g06_audit_summary(spark, sf_dir):
    log = audit_log(spark, sf_dir).withColumn("origin", (F.col("user_id") % 10).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    return A.audit_summary(log)


@query("g07_token_set", "SELECT doc_key, len(list_distinct(list_transform(list_filter(string_split_regex(text, '[\\s]+'), lambda t: (len(t) >= 5 OR (len(t) >= 4 AND regexp_matches(t, '[0-9]'))) AND (regexp_matches(t, '[0-9]') OR len(t) >= 6)), lambda t: lower(t)))) AS tokens FROM (SELECT concat_ws(':', conv_id, turn) AS doc_key, text FROM conversations) WHERE tokens > 0".replace("AS tokens", "::BIGINT AS tokens"))
def g07_token_set(spark, sf_dir):
    turns = readers.read_turns(spark, sf_dir)
    placed = token_hmacs(turns, ["doc_key"], KEY).withColumn("place", F.monotonically_increasing_id())
    return A.token_set(placed, ["doc_key"], 1 << 20).select("doc_key", F.size("hmacs").cast("long").alias("tokens"))


_RUN = "'\\d' || CASE WHEN len({0}) = 1 THEN '' ELSE '{{' || len({0}) || '}}' END"


@query("g08_shape_profile", f"SELECT '\\b[A-Z]{{2}}' || {_RUN.format('c')} || '-' || {_RUN.format('k')} || '\\b' AS regex, CASE WHEN len(c) + len(k) >= 6 THEN 'high' ELSE 'medium' END AS strength, count(*) AS n FROM (SELECT cast(o_custkey AS varchar) AS c, cast(o_orderkey AS varchar) AS k FROM orders) GROUP BY ALL")
def g08_shape_profile(spark, sf_dir):
    """Identifiers made from all orders, grouped by the shape they have."""
    made = table(spark, sf_dir, "orders").select(F.concat(F.lit("AC"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("value"))
    units = made.select(shape_of(F.col("value")).alias("u"))
    return units.groupBy(units_to_regex(F.col("u")).alias("regex"), strength_of(F.col("u")).alias("strength")).agg(F.count("*").alias("n"))


@query("s05_derive_shapes", "SELECT '\\b[A-Z]{2}-\\d{' || len(k) || '}\\b' AS regex, '2 letters, ' || len(k) || CASE WHEN len(k) = 1 THEN ' digit' ELSE ' digits' END AS description, CASE WHEN len(k) >= 6 THEN 'high' ELSE 'medium' END AS strength, count(*) AS n FROM (SELECT cast(o_orderkey AS varchar) AS k FROM orders) GROUP BY ALL".replace("\\d{' || len(k) || '}\\b'", "\\d' || CASE WHEN len(k) = 1 THEN '' ELSE '{' || len(k) || '}' END || '\\b'"))
def s05_derive_shapes(spark, sf_dir):
    """Shapes of order numbers, as a user would teach them."""
    examples = table(spark, sf_dir, "orders").select(F.concat(F.lit("Order: OR-"), F.col("o_orderkey").cast("string")).alias("example"), F.lit("Order").alias("label"))
    found = derive_from_example(examples)
    return found.groupBy("regex", "description", "strength").agg(F.count("*").alias("n"))


@query("s01_shape_of", f"SELECT p_partkey, '\\b[A-Za-z]{{5}}#' || {_RUN.format('d')} || '\\b' AS regex, '5 letters, ' || len(d) || CASE WHEN len(d) = 1 THEN ' digit' ELSE ' digits' END AS description FROM (SELECT p_partkey, split_part(p_brand, '#', 2) AS d FROM part)")
def s01_shape_of(spark, sf_dir):
    shaped = table(spark, sf_dir, "part").select("p_partkey", shape_of(F.col("p_brand")).alias("u"))
    return shaped.select("p_partkey", units_to_regex(F.col("u")).alias("regex"), describe_units(F.col("u")).alias("description"))
