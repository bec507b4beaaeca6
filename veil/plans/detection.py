"""Queries of detection and redaction over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import WS
from ..operators import detectors as D
from ..operators import redact as R
from ..operators.audit import scan_stats
from ..operators.detect import accepts, detect, exploded, find_matches, negatives, strength_points, suggestions, worth_scanning
from ..operators.matching import SPAN, continues, match_all, merge_ranges
from ..sources import readers
from ..sources.readers import table
from .registry import query
from .texts import KEY, LINES, hmac_sql

_BY_ID = {d.id: d for d in (*D.BUILTIN, *D.CATALOG)}
# In SQL without lookaround: separators are doubled, so that neighbours do not share one.
_DOUBLED = r"regexp_replace(text, '([^0-9A-Za-z_-])', '\1\1', 'g')"
_RAW = rf"list_transform(regexp_extract_all({_DOUBLED}, '(?:^|[^0-9A-Za-z_-])([0-9](?:(?:  |-)?[0-9]){{12,18}})(?:$|[^0-9A-Za-z_-])', 1), lambda m: replace(m, '  ', ' '))"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"


def _d(a: int, n: int) -> str:
    return f"CAST(substr({_DIGITS}, {a}, {n}) AS INT)"


_LUHN = f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(({_DIGITS})[len({_DIGITS}) + 1 - i] AS INT) ELSE (2 * CAST(({_DIGITS})[len({_DIGITS}) + 1 - i] AS INT)) % 10 + (2 * CAST(({_DIGITS})[len({_DIGITS}) + 1 - i] AS INT)) // 10 END)) % 10 = 0"
_LEN = f"len({_DIGITS})"
_BRANDED = f"""((m[1] = '4' AND {_LEN} IN (13, 16, 19)) OR (({_d(1, 2)} BETWEEN 51 AND 55 OR {_d(1, 4)} BETWEEN 2221 AND 2720) AND {_LEN} = 16) OR ({_d(1, 2)} IN (34, 37) AND {_LEN} = 15)
 OR (({_d(1, 4)} = 6011 OR {_d(1, 2)} = 65 OR {_d(1, 3)} BETWEEN 644 AND 649 OR {_d(1, 6)} BETWEEN 622126 AND 622925 OR {_d(1, 4)} BETWEEN 3528 AND 3589 OR {_d(1, 2)} = 62) AND {_LEN} BETWEEN 16 AND 19)
 OR (({_d(1, 3)} BETWEEN 300 AND 305 OR {_d(1, 2)} IN (36, 38, 39)) AND {_LEN} BETWEEN 14 AND 19))"""
CARDS = f"list_filter({_RAW}, lambda m: {_BRANDED} AND {_LUHN} AND replace({_DIGITS}, m[1], '') <> '')"
_HIDE = f"regexp_replace(m, '[^{WS}]', '•', 'g')"
REDACTED = f"list_reduce(list_concat([text], {CARDS}), lambda a, m: replace(a, m, {_HIDE}))"
_PHONE = r"(?:^|[^0-9A-Za-z_-])((?:\+?1(?:  |[.-])?)?(?:\([0-9]{3}\)(?:  )?|[0-9]{3}(?:  |[.-])|)[0-9]{3}(?:  |[.-])[0-9]{4})(?:$|[^0-9A-Za-z_-])"


@query("a01_read_documents", f"SELECT * FROM {LINES}")
def a01_read_documents(spark, sf_dir):
    return readers.read_documents(spark, sf_dir)


@query("a01_read_turns", "SELECT concat_ws(':', conv_id, turn) AS doc_key, 0 AS block_id, text FROM conversations")
def a01_read_turns(spark, sf_dir):
    return readers.read_turns(spark, sf_dir)


@query("b05_worth_scanning", rf"SELECT doc_key, block_id, len(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 AS result FROM {LINES}")
def b05_worth_scanning(spark, sf_dir):
    return readers.read_documents(spark, sf_dir).select("doc_key", "block_id", worth_scanning(F.col("text")).alias("result"))


@query(
    "d01_match_all",
    rf"""WITH hits AS (SELECT doc_key, block_id, text, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM {LINES}),
    placed AS (SELECT doc_key, block_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0)
    SELECT doc_key, block_id, m[i] AS text, (coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))::INT AS start,
    (coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + list_sum(list_transform(m[1:i], lambda x: len(x))))::INT AS "end" FROM placed""",
)
def d01_match_all(spark, sf_dir):
    found = readers.read_documents(spark, sf_dir).select("doc_key", "block_id", F.explode(match_all(F.col("text"), "[0-9]+")).alias("m"))
    return found.select("doc_key", "block_id", "m.text", "m.start", "m.end")


@query("d02_card_matches", f"SELECT doc_key, block_id, unnest({CARDS}) AS value FROM {LINES} WHERE regexp_matches(text, '[0-9]')")
def d02_card_matches(spark, sf_dir):
    found = find_matches(readers.read_documents(spark, sf_dir), [_BY_ID["card"]])
    return found.select("doc_key", "block_id", "text", F.explode_outer("matches").alias("m")).where("m is not null").select(
        "doc_key", "block_id", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value")
    )


@query(
    "d03_hex_negatives",
    rf"SELECT doc_key, block_id, count(*) AS n FROM (SELECT doc_key, block_id, unnest(list_filter(string_split_regex(text, '[^0-9A-Za-z_-]+'), lambda t: regexp_matches(t, '^(?:0x)?[0-9a-f]{{8,}}$') AND regexp_matches(t, '[0-9]') AND regexp_matches(regexp_replace(t, '^0x', ''), '[a-f]'))) AS t FROM {LINES}) GROUP BY ALL",
)
def d03_hex_negatives(spark, sf_dir):
    blocks = readers.read_documents(spark, sf_dir)
    negs = F.filter(negatives(), lambda n: n["name"] == "hex")
    return blocks.select("doc_key", "block_id", F.size(negs).cast("long").alias("n")).where("n > 0")


@query("d05_continues", "SELECT o_orderkey, value, regexp_matches(substr(value, 5), '^[-.][0-9]') AS result FROM (SELECT o_orderkey, concat(1000 + o_orderkey % 9000, (['-', '.', ' ', 'x'])[o_orderkey % 4 + 1], o_custkey) AS value FROM orders)")
def d05_continues(spark, sf_dir):
    value = F.expr("concat(cast(1000 + o_orderkey % 9000 as string), element_at(array('-', '.', ' ', 'x'), cast(o_orderkey % 4 as int) + 1), cast(o_custkey as string))")
    made = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return made.select("o_orderkey", "value", F.expr(continues("value", "0", "4")).alias("result"))


_HIGH = [_BY_ID[i] for i in D.HIGH_IDS]


@query("d07_high_matches", f"SELECT doc_key, block_id, 'card' AS pattern, len({CARDS})::BIGINT AS n FROM {LINES} WHERE len({CARDS}) > 0")
def d07_high_matches(spark, sf_dir):
    found = find_matches(readers.read_documents(spark, sf_dir), _HIGH)
    return found.select("doc_key", "block_id", F.explode("matches.pattern").alias("pattern")).groupBy("doc_key", "block_id", "pattern").agg(F.count("*").alias("n"))


_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"


@query("d08_email_matches", rf"SELECT doc_key, block_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM {LINES}")
def d08_email_matches(spark, sf_dir):
    found = find_matches(readers.read_documents(spark, sf_dir), [_BY_ID["email"]])
    return found.select("doc_key", "block_id", "text", F.explode_outer("matches").alias("m")).where("m is not null").select(
        "doc_key", "block_id", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value")
    )


@query(
    "d08_phone_matches",
    rf"SELECT doc_key, block_id, value FROM (SELECT doc_key, block_id, unnest(list_transform(regexp_extract_all({_DOUBLED}, '(?:^|[^0-9A-Za-z_-])((?:[+][+]1(?:  )?)?[(][(][0-9]{{3}}[)][)](?:  )?[0-9]{{3}}-[0-9]{{4}})(?:$|[^0-9A-Za-z_-])', 1), lambda m: replace(replace(replace(replace(m, '  ', ' '), '((', '('), '))', ')'), '++', '+'))) AS value FROM {LINES}) WHERE regexp_matches(regexp_replace(regexp_replace(value, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\1'), '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')",
)
def d08_phone_matches(spark, sf_dir):
    found = find_matches(readers.read_documents(spark, sf_dir), [_BY_ID["phone-us"]])
    return found.select("doc_key", "block_id", "text", F.explode_outer("matches").alias("m")).where("m is not null").select(
        "doc_key", "block_id", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value")
    )


_ACCEPT = "(NOT gated OR bonus >= CASE WHEN sensitivity = 'aggressive' THEN 1 ELSE 2 END) AND CASE sensitivity WHEN 'labeled-only' THEN bonus >= 2 WHEN 'aggressive' THEN strength <> 'low' OR bonus >= 1 ELSE strength = 'high' OR (strength = 'medium' AND bonus >= 1) OR (strength = 'low' AND bonus >= 2) END"
_CASES = "(SELECT o_orderkey, (['high', 'medium', 'low'])[o_orderkey % 3 + 1] AS strength, o_custkey % 4 AS bonus, (['labeled-only', 'balanced', 'aggressive'])[o_orderkey // 3 % 3 + 1] AS sensitivity, o_custkey % 2 = 0 AS gated FROM orders)"


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "element_at(array('high', 'medium', 'low'), cast(o_orderkey % 3 as int) + 1) as strength", "o_custkey % 4 as bonus",
        "element_at(array('labeled-only', 'balanced', 'aggressive'), cast(o_orderkey div 3 % 3 as int) + 1) as sensitivity", "o_custkey % 2 = 0 as gated",
    )


@query("d11_accepts", f"SELECT *, {_ACCEPT} AS result FROM {_CASES}")
def d11_accepts(spark, sf_dir):
    args = (F.col("strength"), F.col("bonus"))
    result = F.when(F.col("sensitivity") == "labeled-only", accepts(*args, "labeled-only", F.col("gated")))
    result = result.when(F.col("sensitivity") == "aggressive", accepts(*args, "aggressive", F.col("gated"))).otherwise(accepts(*args, "balanced", F.col("gated")))
    return _cases(spark, sf_dir).withColumn("result", result)


@query("d12_score", f"SELECT o_orderkey, CASE strength WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + bonus AS result FROM {_CASES}")
def d12_score(spark, sf_dir):
    return _cases(spark, sf_dir).select("o_orderkey", (strength_points(F.col("strength")) + F.col("bonus")).alias("result"))


@query("d13_detect_blocks", f"SELECT doc_key, block_id, 'card' AS pattern, 3 AS score, 0 AS bonus FROM {LINES} WHERE len({CARDS}) > 0")
def d13_detect_blocks(spark, sf_dir):
    return exploded(detect(readers.read_documents(spark, sf_dir))).select("doc_key", "block_id", "pattern", "score", "bonus")


@query("d16_text_cap", f"SELECT doc_key, count(*) AS blocks, count(*) > 40 AS truncated, least(count(*), 40)::BIGINT AS scanned FROM {LINES} GROUP BY doc_key")
def d16_text_cap(spark, sf_dir):
    blocks = readers.read_documents(spark, sf_dir)
    stats = scan_stats(blocks, blocks.limit(0).select("doc_key"), cap=40)
    return stats.select("doc_key", "blocks", "truncated", F.least("blocks", F.lit(40)).cast("long").alias("scanned"))


_SUGGEST = hmac_sql("concat('suggest', chr(0), 'card|', doc_key, '/', block_id, '|')")


@query(
    "d17_suggestions",
    f"WITH hits AS (SELECT doc_key, block_id, {_SUGGEST} AS id FROM {LINES} WHERE len({CARDS}) > 0) SELECT doc_key, id, 'card' AS pattern, 3 AS score, row_number() OVER (PARTITION BY doc_key ORDER BY block_id)::INT AS place, (SELECT count(*) FROM hits h WHERE h.doc_key = hits.doc_key) AS total FROM hits WHERE id[1] <> '0'",
)
def d17_suggestions(spark, sf_dir):
    hits = exploded(detect(readers.read_documents(spark, sf_dir))).withColumn("label", F.lit(None).cast("string"))
    # dismissed before: the identities that begin with 0
    probe = suggestions(hits, spark.createDataFrame([], "id string"), KEY).where("id like '0%'")
    return suggestions(hits, probe, KEY).select("doc_key", "id", "pattern", "score", "place", "total")


@query("d18_locked_cover", f"SELECT doc_key, block_id, CASE WHEN len(text) > 2000 THEN 'range' ELSE 'element' END AS cover, row_number() OVER (PARTITION BY doc_key ORDER BY block_id) <= 200 AS sticker FROM {LINES} WHERE len({CARDS}) > 0")
def d18_locked_cover(spark, sf_dir):
    return R.locked_cover(detect(readers.read_documents(spark, sf_dir)))


@query("d19_switched_on", f"SELECT doc_key, block_id, 'email' AS pattern FROM {LINES} WHERE regexp_matches(text, '{_EMAIL}')")
def d19_switched_on(spark, sf_dir):
    """Toggles that switch all built-ins off and one catalogue entry on."""
    toggles = {e: False for e in D.BUILTIN_ENTRIES} | {"email": True}
    dets = [d for d in D.BUILTIN if d.id not in D.builtin_off(toggles)] + D.catalog_on(toggles)
    found = exploded(detect(readers.read_documents(spark, sf_dir), detectors=dets))
    return found.select("doc_key", "block_id", F.regexp_replace("pattern", "^catalog:", "").alias("pattern"))


@query("d21_detector_of", f"SELECT doc_key, block_id, CASE WHEN len({CARDS}) > 0 THEN 'card' END AS pattern FROM {LINES}")
def d21_detector_of(spark, sf_dir):
    found = find_matches(readers.read_documents(spark, sf_dir), _HIGH)
    return found.select("doc_key", "block_id", F.try_element_at("matches", F.lit(1))["pattern"].alias("pattern"))


@query("d22_preview_count", f"SELECT count(*) AS n FROM {LINES} WHERE regexp_matches(text, '(?:^|[^0-9A-Za-z_])[0-9a-f]{{40}}(?:$|[^0-9A-Za-z_])')")
def d22_preview_count(spark, sf_dir):
    det = D.custom("sha", "Digest", r"\b[0-9a-f]{40}\b", None, [], "high")
    return detect(readers.read_documents(spark, sf_dir), detectors=[det]).where(F.size("hits") > 0).agg(F.count("*").alias("n"))


@query("d09_user_matches", rf"SELECT doc_key, block_id, unnest(regexp_extract_all(text, 'token = \"[0-9a-f]{{40}}\"')) AS value FROM {LINES}")
def d09_user_matches(spark, sf_dir):
    det = D.custom("token", "Token", 'token = "[0-9a-f]{40}"', None, ["token"], "medium")
    found = find_matches(readers.read_documents(spark, sf_dir), [det])
    return found.select("doc_key", "block_id", "text", F.explode_outer("matches").alias("m")).where("m is not null").select(
        "doc_key", "block_id", F.substring("text", F.col("m.start") + 1, F.col("m.end") - F.col("m.start")).alias("value")
    )


def _stems(text: str) -> str:
    """SQL of the stems of a text's words."""
    plain = f"regexp_replace(regexp_replace(lower({text}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
    stem = "regexp_replace(regexp_replace(regexp_replace(replace(w, 'licence', 'license'), 'ies$', 'y'), '([^s])s$', '\\1'), 'e$', '')"
    return f"list_transform(list_filter(string_split({plain}, ' '), lambda w: w <> ''), lambda w: {stem})"


def _catalog_sql() -> str:
    from ..operators.teach import STOP, catalog_words

    values = ", ".join(f"({n}, '{e}', '{w.replace(chr(39), chr(39) * 2)}')" for n, e, w in catalog_words())
    return f"""
      WITH asked AS (SELECT DISTINCT lower(c_mktsegment) || ' ' || lower(substr(o_orderpriority, 3)) || ' card for birth' AS query FROM orders JOIN customer ON o_custkey = c_custkey),
      q AS (SELECT query, {_stems("query")} AS q FROM asked), s AS (SELECT {_stems(f"'{STOP}'")} AS stop), e(n, entry, said) AS (VALUES {values}),
      m AS (SELECT n, entry, list_sort(list_distinct(list_filter(stems, lambda w: NOT list_contains(stop, w)))) AS means FROM (SELECT n, entry, {_stems("said")} AS stems FROM e), s),
      p AS (SELECT DISTINCT query, n, entry, means, list_has_all(q, means) AS whole FROM q JOIN m ON list_has_any(q, means)),
      r AS (SELECT query, n, entry, sum(CASE WHEN whole THEN 2 * len(means) ELSE 1 END)::BIGINT AS score FROM p GROUP BY query, n, entry)
      SELECT query, entry, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, n)::INT AS place FROM r"""


@query("d20_find_catalog", _catalog_sql())
def d20_find_catalog(spark, sf_dir):
    """What customers are in and how urgent their orders are, as queries against the catalogue."""
    from ..operators.teach import find_catalog

    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = joined.select(F.concat(F.lower("c_mktsegment"), F.lit(" "), F.lower(F.substring("o_orderpriority", 3, 99)), F.lit(" card for birth")).alias("query")).distinct()
    return find_catalog(asked)


_RANGES = "list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda m: m)"


@query("r03_merge_ranges", "WITH r AS (SELECT l_orderkey, l_partkey % 50 AS s, l_partkey % 50 + l_quantity::INT % 12 AS e FROM lineitem), o AS (SELECT *, max(least(e, 55)) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE least(e, 55) > s), i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT l_orderkey, min(s)::INT AS start, max(least(e, 55))::INT AS \"end\" FROM i GROUP BY l_orderkey, island")
def r03_merge_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("struct(cast(l_partkey % 50 as int) as start, cast(l_partkey % 50 + cast(l_quantity as int) % 12 as int) as end)").alias("r"))
    merged = ranges.groupBy("l_orderkey").agg(F.collect_list("r").alias("rs")).select("l_orderkey", F.explode(merge_ranges(F.col("rs").cast(SPAN), F.lit(55))).alias("m"))
    return merged.select("l_orderkey", "m.start", "m.end")


@query("r04_redact_ranges", "SELECT doc_id, substr(text, 1, 10) || regexp_replace(substr(text, 11, 20), '[^" + WS + "]', '•', 'g') || substr(text, 31) AS redacted FROM documents")
def r04_redact_ranges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranges = F.expr("array(struct(20 as start, 30 as end), struct(10 as start, 22 as end))").cast(SPAN)
    return docs.select("doc_id", R.redact_ranges(F.col("text"), ranges).alias("redacted"))


@query("r05_redact_detected", f"SELECT doc_key, block_id, {REDACTED} AS redacted, len({CARDS})::INT AS n_hits FROM {LINES}")
def r05_redact_detected(spark, sf_dir):
    return R.redact_detected(readers.read_documents(spark, sf_dir)).select("doc_key", "block_id", "redacted", "n_hits")


@query("r05_redact_elements", f"SELECT doc_key, block_id, CASE WHEN len({CARDS}) = 0 THEN text WHEN len(text) > 2000 THEN {REDACTED} ELSE regexp_replace(text, '[^{WS}]', '•', 'g') END AS redacted FROM {LINES}")
def r05_redact_elements(spark, sf_dir):
    """Blocks of up to 2000 characters are covered whole, longer ones at their hits."""
    return R.redact_detected(readers.read_documents(spark, sf_dir), mode="element").select("doc_key", "block_id", "redacted")


@query("r05_redact_turns", f"SELECT doc_key, 0 AS block_id, {REDACTED} AS redacted FROM (SELECT concat_ws(':', conv_id, turn) AS doc_key, text FROM conversations)")
def r05_redact_turns(spark, sf_dir):
    return R.redact_detected(readers.read_turns(spark, sf_dir)).select("doc_key", "block_id", "redacted")


@query("r06_snap_to_tokens", rf"SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[^{WS}]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN len(t) ELSE 0 END), 'sum')::BIGINT AS hidden, array_to_string(list_filter(regexp_extract_all(text, '[^{WS}]+'), lambda t: regexp_matches(t, '[0-9]')), ' ') AS tokens FROM documents")
def r06_snap_to_tokens(spark, sf_dir):
    """Every digit of whole texts grown to its token: what is hidden, white space between neighbours left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    given = docs.withColumn("spans", R.snap_to_tokens(F.col("text"), R.ranges_of(match_all(F.col("text"), "[0-9]+"))))
    texts = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    bare = F.array_join(F.flatten(F.transform(texts, lambda t: F.filter(F.split(t, f"[{WS}]+"), lambda w: w != ""))), " ")
    return given.select("doc_id", F.coalesce(F.length(F.regexp_replace(bare, " ", "")), F.lit(0)).cast("long").alias("hidden"), bare.alias("tokens"))


@query("r10_restore", f"SELECT doc_key, block_id, text FROM {LINES}")
def r10_restore(spark, sf_dir):
    blocks = readers.read_documents(spark, sf_dir)
    masked = R.redact_detected(blocks).select("doc_key", "block_id", "redacted")
    return R.restore(masked, blocks, ["doc_key", "block_id"]).select("doc_key", "block_id", "text")


@query("d02_detector_counts", None)
def d02_detector_counts(spark, sf_dir):
    """Matches by detector over identifiers made from all orders, in a sentence with a label."""
    made = readers.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").cast("string").alias("doc_key"), F.lit(0).alias("block_id"),
        F.expr("concat(element_at(array('SSN ', 'EIN ', 'routing ', 'account ', 'born '), cast(o_orderkey % 5 as int) + 1), element_at(array(concat_ws('-', lpad(cast(o_orderkey % 1000 as string), 3, '0'), lpad(cast(o_custkey % 100 as string), 2, '0'), lpad(cast(o_orderkey % 10000 as string), 4, '0')), concat(lpad(cast(o_custkey % 100 as string), 2, '0'), '-', lpad(cast(o_orderkey % 10000000 as string), 7, '0')), lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0'), concat('AC', lpad(cast(o_orderkey as string), 10, '0')), concat_ws('/', cast(o_orderkey % 12 + 1 as string), cast(o_custkey % 28 + 1 as string), '1980')), cast(o_orderkey % 5 as int) + 1))").alias("text"),
    )
    hits = exploded(detect(made, keep="all"))
    return hits.groupBy("pattern", "strength", "bonus").agg(F.count("*").alias("n"))


