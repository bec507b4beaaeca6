"""Queries of joins, windows and set operations over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import WS
from ..functions.identity import identity, view_prefix
from ..operators import windows as W
from ..sources import merged, readers
from ..sources.readers import table
from ..sources.store import shared_dir
from .registry import query
from .texts import HOST, KEY, PATH, SANITIZED, SEARCH, TURNS, hmac_sql

_ORIGIN = "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
_NORMAL = "'/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/')"
_PAGES = f"(SELECT page_id, url, {_ORIGIN} AS origin, {HOST} AS host, {PATH} AS path, {SEARCH} AS query FROM pages)"


def _pages(spark, sf_dir):
    host, path, search = U.url_parts(F.col("url"))
    origin = F.lower(F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", "url", origin.alias("origin"), host.alias("host"), path.alias("path"), search.alias("query"))


@query(
    "j02_scope_join",
    f"WITH p AS {_PAGES}, r AS (SELECT DISTINCT origin, {SANITIZED} AS path_pattern FROM p) SELECT p.page_id, p.origin || r.path_pattern AS rule_id FROM p JOIN r ON p.origin = r.origin"
    " AND regexp_matches('/' || array_to_string(list_filter(string_split(p.path, '/'), lambda s: s <> ''), '/'), '^' || regexp_replace(regexp_replace(r.path_pattern, '[.]', '[.]', 'g'), '/[*]', '/[^/]+', 'g') || '$')",
)
def j02_scope_join(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rules = pages.select("origin", U.sanitize_path(F.col("path")).alias("path_pattern")).distinct()
    return W.scope_join(pages, rules.withColumn("rule_id", F.concat("origin", "path_pattern")))


@query("j03_exact_scope_join", f"WITH p AS {_PAGES}, r AS (SELECT min(page_id) AS rule_id, path FROM (SELECT page_id, {_NORMAL} AS path FROM p) GROUP BY path) SELECT p.page_id, r.rule_id FROM p JOIN r ON {_NORMAL.replace('path', 'p.path')} = r.path")
def j03_exact_scope_join(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    made = pages.select("page_id", identity("path", U.normalize_path(F.col("path")), KEY).alias("path_hmac"))
    rules = made.groupBy("path_hmac").agg(F.min("page_id").alias("rule_id")).withColumn("include_query", F.lit(False))
    return W.exact_scope_join(pages, rules, KEY)


_FRAMES = "(SELECT page_id, page_id % 3 AS depth, url FROM pages)"


def _frames(spark, sf_dir):
    frames = table(spark, sf_dir, "pages").select(F.col("page_id").alias("frame_id"), (F.col("page_id") % 3).alias("depth"), identity("frame", F.col("url"), KEY).alias("frame_hmac"))
    return frames, frames.select(F.col("frame_id").alias("rule_id"), "depth", F.when(F.col("depth") > 0, F.col("frame_hmac")).alias("url_hmac"))


@query("j04_frame_applies", f"SELECT a.page_id AS frame_id, b.page_id AS rule_id FROM {_FRAMES} a JOIN {_FRAMES} b ON a.depth = b.depth AND b.depth > 0 AND lower(trim(a.url)) = lower(trim(b.url))")
def j04_frame_applies(spark, sf_dir):
    return W.frame_join(*_frames(spark, sf_dir))


@query("j04_frame_rules", f"SELECT depth, array_to_string(list(page_id ORDER BY page_id), ' ') AS rules FROM {_FRAMES} WHERE depth = 0 GROUP BY depth")
def j04_frame_rules(spark, sf_dir):
    return W.frame_rules(_frames(spark, sf_dir)[1]).select("depth", F.array_join(F.col("rule_ids").cast("array<string>"), " ").alias("rules"))


_TOKENS = rf"(SELECT doc_key, unnest(list_distinct(list_filter(string_split_regex(text, '[{WS}]+'), lambda t: (len(t) >= 5 OR (len(t) >= 4 AND regexp_matches(t, '[0-9]'))) AND (regexp_matches(t, '[0-9]') OR len(t) >= 6)))) AS token FROM {TURNS})"


@query("j09_token_backstop", f"SELECT doc_key, token FROM {_TOKENS} WHERE lower(trim(token)) IN (SELECT lower(trim(token)) FROM {_TOKENS} WHERE doc_key LIKE '%:0')")
def j09_token_backstop(spark, sf_dir):
    turns = readers.read_turns(spark, sf_dir)
    wanted = W.token_hmacs(turns.where("doc_key like '%:0'"), ["doc_key"], KEY)
    return W.token_backstop(turns, ["doc_key"], wanted, KEY).select("doc_key", "token")


_VIEW = "lower(substr(regexp_replace(text, '[" + WS + "]', '', 'g'), 1, {n}))"


@query("j11_view_match", f"SELECT d.doc_id, v.doc_id AS view_id FROM documents d JOIN (SELECT doc_id, 40 + doc_id % 2 * 80 AS n, {_VIEW.format(n='40 + doc_id % 2 * 80')} AS p FROM documents) v ON len(regexp_replace(d.text, '[{WS}]', '', 'g')) >= v.n AND {_VIEW.format(n='v.n').replace('text', 'd.text')} = v.p")
def j11_view_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = F.expr("cast(40 + doc_id % 2 * 80 as int)")
    wanted = docs.select(F.col("doc_id").alias("view_id"), length.alias("length"), view_prefix(F.col("text"), length, KEY).alias("hmac"))
    return W.view_match(docs, wanted, KEY)


@query(
    "j12_locate_exact",
    f"WITH b AS (SELECT doc_key, regexp_replace(text, '[{WS}]', '', 'g') AS t FROM {TURNS}), h AS (SELECT doc_key, t, unnest(range(0, len(t))) AS pos FROM b), n AS (SELECT doc_key, pos, abs(pos - 20) AS far FROM h WHERE substr(t, pos + 1, 2) = 'en') SELECT doc_key, arg_min(pos, far * 100000 + pos)::INT AS \"at\" FROM n GROUP BY doc_key",
)
def j12_locate_exact(spark, sf_dir):
    asked = readers.read_turns(spark, sf_dir).withColumn("needle", F.lit("e n")).withColumn("near", F.lit(20))
    return W.locate_exact(asked, ["doc_key"])


_LAST_WORD = f"regexp_extract(text, '([^{WS}]+)[{WS}]*$', 1)"


@query(
    "j12_locate_last_words",
    f"WITH b AS (SELECT doc_key, regexp_replace(text, '[{WS}]', '', 'g') AS t, {_LAST_WORD} AS w, len(text) % 40 AS near FROM {TURNS}), h AS (SELECT doc_key, t, w, near, unnest(range(0, len(t))) AS pos FROM b WHERE w <> '') SELECT doc_key, arg_min(pos, abs(pos - near) * 100000 + pos)::INT AS \"at\" FROM h WHERE substr(t, pos + 1, len(w)) = w GROUP BY doc_key",
)
def j12_locate_last_words(spark, sf_dir):
    """Each turn's last word, where it stands nearest to a place that depends on the turn."""
    turns = readers.read_turns(spark, sf_dir)
    asked = turns.withColumn("needle", F.regexp_extract("text", rf"([^{WS}]+)[{WS}]*\z", 1)).withColumn("near", (F.length("text") % 40).cast("int"))
    return W.locate_exact(asked, ["doc_key"])


@query(
    "j13_locate_by_hash",
    f"WITH w AS (SELECT doc_key, substr(text, 6, 12) AS v FROM {TURNS} WHERE len(text) >= 17), t AS (SELECT doc_key, text, unnest(range(0, len(text) - 11)) AS pos FROM {TURNS} WHERE len(text) >= 17) SELECT t.doc_key, 'covered' AS target, arg_min(pos, abs(pos - 7) * 1000 + pos)::INT AS \"at\" FROM t JOIN w USING (doc_key) WHERE substr(t.text, pos + 1, 12) = w.v GROUP BY t.doc_key",
)
def j13_locate_by_hash(spark, sf_dir):
    from ..functions.identity import hmac

    turns = readers.read_turns(spark, sf_dir)
    wanted = turns.where(F.length("text") >= 17).select("doc_key", F.lit("covered").alias("target"), F.lit(12).alias("length"), F.lit(7).alias("near"), hmac(F.concat(F.lit("cover\0"), F.substring("text", 6, 12)), KEY).alias("hmac"))
    return W.locate_by_hash(turns, ["doc_key"], wanted, KEY)


_RECTS = "SELECT l_orderkey AS doc, l_linenumber AS rect_id, (l_partkey % 500)::DOUBLE AS x, (l_suppkey % 900)::DOUBLE AS y, l_quantity::DOUBLE AS w, l_quantity * 2.0::DOUBLE AS h FROM lineitem"
_BOXES = "SELECT o_orderkey AS doc, page, 0.0::DOUBLE AS px, page * 450.0::DOUBLE AS py, 400.0::DOUBLE AS pw, 440.0::DOUBLE AS ph, 600.0::DOUBLE AS width, 660.0::DOUBLE AS height FROM orders, (SELECT unnest([0, 1]) AS page)"


@query(
    "j14_page_rects",
    f"SELECT doc, rect_id, page, x0 * 1.5 AS x, (y0 - py) * 1.5 AS y, (x1 - x0) * 1.5 AS w, (y1 - y0) * 1.5 AS h FROM (SELECT doc, rect_id, page, py, greatest(x, px) AS x0, greatest(y, py) AS y0, least(x + w, px + pw) AS x1, least(y + h, py + ph) AS y1 FROM ({_RECTS}) JOIN ({_BOXES}) USING (doc)) WHERE x1 > x0 AND y1 > y0",
)
def j14_page_rects(spark, sf_dir):
    rects = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as doc", "l_linenumber as rect_id", "cast(l_partkey % 500 as double) as x", "cast(l_suppkey % 900 as double) as y", "cast(l_quantity as double) as w", "cast(l_quantity as double) * 2 as h")
    boxes = table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc", "explode(array(0, 1)) as page").selectExpr("doc", "page", "0D as px", "page * 450D as py", "400D as pw", "440D as ph", "600D as width", "660D as height")
    return W.page_rects(rects, boxes)


_MARKS = "SELECT l_suppkey % 10 AS doc, l_orderkey * 10 + l_linenumber AS rect_id, (l_partkey * 37 % 4000)::DOUBLE AS x, (l_orderkey * 53 % 4000)::DOUBLE AS y, l_quantity::DOUBLE AS w, CASE WHEN l_linenumber = 1 THEN 900 ELSE 8 END::DOUBLE AS h FROM lineitem"
_TILES = "SELECT o_orderkey % 10 AS doc, o_orderkey AS page, (o_custkey * 91 % 4000)::DOUBLE AS px, (o_orderkey * 17 % 4000)::DOUBLE AS py, (5 + o_orderkey % 60)::DOUBLE AS pw, (5 + o_custkey % 90)::DOUBLE AS ph FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 < 3"


@query(
    "j14_many_boxes",
    f"SELECT doc, rect_id, page, x0 - px AS x, y0 - py AS y, x1 - x0 AS w, y1 - y0 AS h FROM (SELECT *, greatest(x, px) AS x0, greatest(y, py) AS y0, least(x + w, px + pw) AS x1, least(y + h, py + ph) AS y1 FROM ({_MARKS}) JOIN ({_TILES}) USING (doc)) WHERE x1 > x0 AND y1 > y0",
)
def j14_many_boxes(spark, sf_dir):
    """Ten documents with all line items as rectangles and hundreds of boxes of many sizes."""
    double = lambda e: f"cast({e} as double)"
    rects = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 10 as doc", "l_orderkey * 10 + l_linenumber as rect_id", f"{double('l_partkey * 37 % 4000')} as x", f"{double('l_orderkey * 53 % 4000')} as y", f"{double('l_quantity')} as w", f"{double('if(l_linenumber = 1, 900, 8)')} as h")
    boxes = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0 or o_orderkey % 10 < 3").selectExpr("o_orderkey % 10 as doc", "o_orderkey as page", f"{double('o_custkey * 91 % 4000')} as px", f"{double('o_orderkey * 17 % 4000')} as py", f"{double('5 + o_orderkey % 60')} as pw", f"{double('5 + o_custkey % 90')} as ph")
    return W.page_rects(rects, boxes.selectExpr("*", "pw as width", "ph as height"))


@query("w02_first_per_key", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place FROM events) WHERE place <= 20")
def w02_first_per_key(spark, sf_dir):
    return W.newest(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 20, "place").select("user_id", "event_id", "place")


@query("w03_newest_per_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def w03_newest_per_key(spark, sf_dir):
    return W.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query("w04_upsert", "SELECT c_custkey, name, updated_at FROM (SELECT c_custkey, c_name AS name, 0::BIGINT AS updated_at, false AS removed, 0 AS fresh FROM customer UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_orderkey, o_orderkey % 11 = 0, 1 FROM orders) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY updated_at DESC, fresh DESC) = 1 AND NOT removed")
def w04_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as name", "0L as updated_at")
    changes = table(spark, sf_dir, "orders").selectExpr("o_custkey as c_custkey", "concat('order ', o_orderkey) as name", "cast(o_orderkey as bigint) as updated_at", "o_orderkey % 11 = 0 as removed")
    return W.upsert(base, changes, ["c_custkey"])


@query("w04_merge_table", "SELECT c_custkey, name, updated_at FROM (SELECT c_custkey, c_name AS name, 0::BIGINT AS updated_at, false AS removed, 0 AS fresh FROM customer UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_orderkey, o_orderkey % 11 = 0, 1 FROM orders) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY updated_at DESC, fresh DESC) = 1 AND NOT removed")
def w04_merge_table(spark, sf_dir):
    """w04_upsert by way of a table in buckets: all customers, then the orders of customers with odd numbers, then of the others."""
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as name", "0L as updated_at")
    changes = table(spark, sf_dir, "orders").selectExpr("o_custkey as c_custkey", "concat('order ', o_orderkey) as name", "cast(o_orderkey as bigint) as updated_at", "o_orderkey % 11 = 0 as removed")
    target = merged.MergeTable(spark, f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", ["c_custkey"], base.schema, 8)
    merged.upsert_into(target, base.withColumn("removed", F.lit(False)), 0)
    merged.upsert_into(target, changes.where("c_custkey % 2 = 1"), 1)
    merged.upsert_into(target, changes.where("c_custkey % 2 = 0"), 2)
    return target.read()


@query("w05_merge_intervals", "WITH r AS (SELECT l_suppkey, l_partkey % 5000 AS s, l_partkey % 5000 + l_quantity::INT AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT l_suppkey, min(s) AS start, max(e) AS \"end\" FROM i GROUP BY l_suppkey, island")
def w05_merge_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey % 5000 as start", "l_partkey % 5000 + cast(l_quantity as int) as end")
    return W.merge_intervals(rows, ["l_suppkey"])


@query("w09_nearest", "SELECT l_orderkey, arg_min(l_linenumber, abs(l_partkey - l_suppkey) * 100 + l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def w09_nearest(spark, sf_dir):
    return W.nearest(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.abs(F.col("l_partkey") - F.col("l_suppkey")), "l_linenumber")


@query("x02_minus", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def x02_minus(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))


@query("x03_intersect", "SELECT l_suppkey AS id FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def x03_intersect(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("x04_reconcile", "WITH w AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 5 = 0), p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0) SELECT *, 'stale' AS state FROM (FROM p EXCEPT FROM w) UNION ALL SELECT *, 'missing' FROM (FROM w EXCEPT FROM p)")
def x04_reconcile(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id")).distinct()
    return W.reconcile(wanted, table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id")))
