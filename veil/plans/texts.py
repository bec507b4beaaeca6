"""Queries of text, label, token, identity and URL functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions import urls as U
from ..functions.dialect import WS
from ..operators import redact as R
from ..sources import readers
from ..sources.readers import table
from .registry import query

#: The key of the queries; a job gets its own as a parameter.
KEY = b"veil-test-key-0123456789abcdef!!"
INNER, OUTER = I.pads(KEY)

LINES = "(SELECT CAST(doc_id AS VARCHAR) AS doc_key, generate_subscripts(l, 1)::INT - 1 AS block_id, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
TURNS = "(SELECT concat_ws(':', conv_id, turn) AS doc_key, 0 AS block_id, text FROM conversations)"
PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)', 1))"
SEARCH = r"regexp_extract(url, '\?([^#]*)', 1)"


def hmac_sql(message: str) -> str:
    return f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode({message}))))"


def _blocks(name: str, column, sql: str, source: str = "turns") -> None:
    """(doc_key, block_id, result) of a column function of text over every block."""

    @query(name, f"SELECT doc_key, block_id, {sql} AS result FROM {LINES if source == 'lines' else TURNS}")
    def run(spark, sf_dir):
        blocks = readers.read_documents(spark, sf_dir) if source == "lines" else readers.read_turns(spark, sf_dir)
        return blocks.select("doc_key", "block_id", column(F.col("text")).alias("result"))


_COLLAPSED = f"trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))"
_LABEL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '#', ' number ', 'g'), '[''’]', '', 'g'), '[^a-z]+', ' ', 'g'))"
_WORDS = f"list_distinct(list_filter(string_split_regex(text, '[{WS}]+'), lambda t: len(t) >= 5 OR (len(t) >= 4 AND regexp_matches(t, '[0-9]'))))"


def _listed(sql: str) -> str:
    return f"array_to_string(list_sort({sql}), ' ')"


def _sorted(column):
    return lambda t: F.array_join(F.sort_array(column(t)), " ")


_blocks("t01_normalize_text", T.normalize_text, f"lower({_COLLAPSED})")
_blocks("t02_normalize_context", T.normalize_context, r"nullif(substr(trim(regexp_replace(regexp_replace(lower(text), '\p{Nd}+', ' ', 'g'), '[^\p{L}]+', ' ', 'g')), 1, 40), '')", "lines")
_blocks("t03_normalize_label", T.normalize_label, _LABEL.format("text"), "lines")
_blocks("t04_normalize_label_words", T.normalize_label_words, r"substr(trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')), 1, 40)")
_KIND_SQL = ", ".join(f"CASE WHEN regexp_matches(' ' || {_LABEL.format('text')} || ' ', '[^a-z](?:{p})[^a-z]') THEN '{k}' END" for k, p in T.KIND_WORDS.items())
_blocks("t05_label_kinds", lambda t: F.array_join(T.label_kinds(t), " "), f"array_to_string(list_filter([{_KIND_SQL}], lambda k: k IS NOT NULL), ' ')", "lines")
_blocks("t06_has_kind", lambda t: T.has_kind(T.label_kinds(t), ["card", "id"]), f"regexp_matches(' ' || {_LABEL.format('text')} || ' ', '[^a-z](?:{T.KIND_WORDS['card']}|{T.KIND_WORDS['id']})[^a-z]')", "lines")
_blocks(
    "t08_keyword_test", lambda t: T.keyword_test(t, F.array(F.lit("license version"), F.lit("token"), F.lit("all rights"))),
    f"regexp_matches(' ' || {_LABEL.format('text')} || ' ', ' (?:license version|token|all rights) ')", "lines",
)
_blocks("t09_tokens_of", _sorted(lambda t: T.tokens_of(t)[0]), _listed(_WORDS))
_blocks(
    "t10_leaks", lambda t: T.leaks(t, F.array(F.lit("tion"), F.lit("nment")), F.array(F.lit("123456"))),
    "contains(text, 'tion') OR contains(text, 'nment') OR contains(regexp_replace(text, '[^0-9]', '', 'g'), '123456')", "lines",
)
_blocks("t12_hmac_text", lambda t: I.identity("text", t, KEY), hmac_sql(f"lower({_COLLAPSED})"))
_blocks("t12_hmac_cover", lambda t: I.identity("cover", t, KEY), hmac_sql(f"concat('cover', chr(0), {_COLLAPSED})"))
_blocks("t12_hmac_token", lambda t: I.identity("token", t, KEY), hmac_sql("concat('token', chr(0), lower(trim(text)))"))
_blocks(
    "t13_jaccard", lambda t: T.jaccard(F.split(t, " "), F.array(F.lit("the"), F.lit("of"), F.lit("la"), F.lit("die"))),
    "len(list_intersect(list_distinct(string_split(text, ' ')), ['the', 'of', 'la', 'die'])) / (len(list_distinct(list_concat(string_split(text, ' '), ['the', 'of', 'la', 'die']))))::DOUBLE",
)
_blocks("t14_doc_key", lambda t: T.doc_key(F.encode(t, "UTF-8")), "concat('/pdf/', translate(substr(sha256(encode(text)), 1, 16), '0123456789abcdef', 'ghijklmnopqrstuv'))")
_blocks("r01_bullets", R.bullets, f"regexp_replace(text, '[^{WS}]', '•', 'g')", "lines")
_blocks("r02_mask_value", R.mask_value, "repeat('•', len(text))")


@query(
    "t11_is_tracking",
    "SELECT o_orderkey, value, regexp_matches(value, '(?i)^1Z[0-9A-Z]{16}$') OR regexp_matches(value, '^(?:82|9[2-5])[0-9]{18,20}$') OR regexp_matches(value, '^[A-Z]{2}[0-9]{9}[A-Z]{2}$') AS result"
    " FROM (SELECT o_orderkey, concat((['1Z', '94', 'RR', 'XX'])[o_orderkey % 4 + 1], lpad(cast(o_orderkey * 7919 as varchar), ([16, 20, 9, 9])[o_orderkey % 4 + 1], '0'), (['', '', 'US', '1'])[o_orderkey % 4 + 1]) AS value FROM orders)",
)
def t11_is_tracking(spark, sf_dir):
    value = F.expr(
        "concat(element_at(array('1Z', '94', 'RR', 'XX'), cast(o_orderkey % 4 as int) + 1), lpad(cast(o_orderkey * 7919 as string), element_at(array(16, 20, 9, 9), cast(o_orderkey % 4 as int) + 1), '0'), element_at(array('', '', 'US', '1'), cast(o_orderkey % 4 as int) + 1))"
    )
    made = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return made.select("o_orderkey", "value", F.expr(T.is_tracking("value", "''")).alias("result"))


@query(
    "t15_file_names",
    r"SELECT page_id, name, concat(trim(regexp_replace(regexp_replace(name, '(?i)\.pdf$', ''), '[\\/:*?\"<>|[:cntrl:]]+', '_', 'g')), '-redacted.pdf') AS redacted,"
    r" regexp_matches(url, '(?i)^(?:https?|file)://[^?#]*\.pdf$') AS is_pdf"
    r" FROM (SELECT page_id, url, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '([^/]*)/*$', 1), ''), 'document.pdf') AS name FROM pages)",
)
def t15_file_names(spark, sf_dir):
    url = F.col("url")
    name = T.file_name_from_url(url)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), T.redacted_file_name(name).alias("redacted"), T.looks_like_pdf_url(url).alias("is_pdf"))


_RECT_SQL = "SELECT l_orderkey, l_linenumber, l_partkey % 700 / 7.0::DOUBLE AS x, l_suppkey % 900 / 9.0::DOUBLE AS y, l_quantity::DOUBLE AS w, (l_linenumber * 3.5)::DOUBLE AS h FROM lineitem"


@query(
    "t18_fill_rects",
    f"SELECT l_orderkey, l_linenumber, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM (SELECT l_orderkey, l_linenumber, greatest(floor(x * 2), 0)::BIGINT AS x0, greatest(floor(y * 2), 0)::BIGINT AS y0, least(ceil((x + w) * 2), 200)::BIGINT AS x1, least(ceil((y + h) * 2), 180)::BIGINT AS y1 FROM ({_RECT_SQL})) WHERE x1 > x0 AND y1 > y0",
)
def t18_fill_rects(spark, sf_dir):
    box = F.expr("struct(cast(l_partkey % 700 as double) / 7 as x, cast(l_suppkey % 900 as double) / 9 as y, cast(l_quantity as double) as w, cast(l_linenumber as double) * 3.5 as h)")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.fill_rects(F.array(box), 2.0, F.lit(200), F.lit(180))).alias("r"))
    return found.select("l_orderkey", "l_linenumber", "r.*")


def _urls(name: str, column, sql: str) -> None:
    """(page_id, result) of a function of (host, path, query) over every page."""

    @query(name, f"SELECT page_id, {sql} AS result FROM (SELECT page_id, url, {HOST} AS host, {PATH} AS path, {SEARCH} AS query FROM pages)")
    def run(spark, sf_dir):
        host, path, search = U.url_parts(F.col("url"))
        parts = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), path.alias("path"), search.alias("query"))
        return parts.select("page_id", column().alias("result"))


_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_SEGS = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_ID_LIKE = f"regexp_matches(s, '^(?:[0-9]+|{_UUID}|[0-9a-fA-F]{{8,}}|[A-Z]{{1,3}}-?[0-9]{{4,}})$')"
_DOC_ID = f"(len(s) >= 16 AND regexp_matches(s, '^[A-Za-z0-9_-]+$') AND (regexp_matches(s, '^(?:{_UUID}|[0-9a-fA-F]+)$') OR (NOT regexp_matches(s, '^[a-z]+(?:[-_][a-z]+)*$') AND ((regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')) OR (len(regexp_replace(s, '[^A-Z]', '', 'g')) >= 3 AND regexp_matches(s, '[a-z]') AND NOT regexp_matches(s, '[-_]'))))))"
_GENERAL = f"CASE WHEN s IN ('*', '**') THEN s WHEN {_ID_LIKE} OR {_DOC_ID} OR regexp_matches(s, '[0-9]{{4,}}') THEN '*' ELSE s END"
SANITIZED = f"'/' || array_to_string(list_transform({_SEGS}, lambda s: {_GENERAL}), '/')"
_PAIRS = "list_filter(string_split(query, '&'), lambda p: p <> '')"
_DOC_HOST = "(host IN ('drive.google.com', 'docs.google.com', 'app.hubspot.com') OR regexp_matches(host, '(?:^|[.])(?:sharepoint[.]com|dropbox[.]com|box[.]com|notion[.]so)$'))"
_DOC_QUERY = f"len(list_filter(list_transform({_PAIRS}, lambda p: url_decode(regexp_extract(p, '^[^=]*=?(.*)$', 1))), lambda s: {_DOC_ID})) > 0"

_urls("u01_id_like_segments", lambda: F.size(F.filter(U.split_path(F.col("path")), U.is_id_like_segment)), f"len(list_filter({_SEGS}, lambda s: {_ID_LIKE}))::INT")
_urls("u02_doc_id_segments", lambda: F.size(F.filter(U.split_path(F.col("path")), U.is_doc_id_segment)), f"len(list_filter({_SEGS}, lambda s: {_DOC_ID}))::INT")
_urls("u03_normalize_path", lambda: U.normalize_path(F.col("path")), f"'/' || array_to_string({_SEGS}, '/')")
_urls("u04_sanitize_path", lambda: U.sanitize_path(F.col("path")), SANITIZED)
_urls("u05_prefix_pattern", lambda: U.prefix_pattern(F.col("path")), f"CASE WHEN len({_SEGS}) <= 1 THEN '/**' ELSE '/' || array_to_string(list_transform(({_SEGS})[:-2], lambda s: {_GENERAL}), '/') || '/**' END")
_urls("u06_default_scope_kind", lambda: U.default_scope_kind(F.col("host"), F.col("path"), F.col("query")), f"CASE WHEN {_DOC_HOST} OR len(list_filter({_SEGS}, lambda s: {_DOC_ID})) > 0 OR {_DOC_QUERY} THEN 'exact' ELSE 'pattern' END")
_urls("u07_canonical_search", lambda: U.canonical_search(F.col("query")), f"CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform({_PAIRS}, lambda p, i: {{'name': regexp_extract(p, '^([^=]*)', 1), 'place': i, 'pair': p}})), lambda x: x.pair), '&') END")
_urls("u08_make_scope", lambda: F.coalesce(U.make_scope(F.col("url"), F.lit("pattern"), KEY)["path_pattern"], F.lit("")), SANITIZED)
_urls("u08_frame_descriptor", lambda: U.frame_descriptor(F.col("url"), F.lit(1), KEY)["url_hmac"], hmac_sql(f"concat('frame', chr(0), lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)), '/', array_to_string({_SEGS}, '/'))"))
_urls("u09_parse_origin", lambda: U.parse_origin(F.regexp_extract(F.col("url"), r"^([a-zA-Z]+://[^/?#]*)", 1)), "lower(nullif(regexp_extract(url, '^(https?://[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?(?::[0-9]{1,5})?)(?:[/?#].*)?$', 1), ''))")
_urls("u10_known_canvas_app", lambda: U.known_canvas_app(F.col("host"), F.col("path")), "(host = 'docs.google.com' AND regexp_matches(path, '^/(?:document|presentation|spreadsheets)(?:/|$)')) OR host IN ('www.figma.com', 'excalidraw.com', 'miro.com', 'lucid.app')")


@query("u10_classify_rendering", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 8 >= 0.4 AND l_quantity * 10 < 300 THEN 'canvas' WHEN l_discount * 8 >= 0.15 THEN 'mixed' ELSE 'dom' END AS result FROM lineitem")
def u10_classify_rendering(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.classify_rendering(F.col("l_discount") * 8, F.col("l_quantity") * 10).alias("result"))


@query("u11_url_profile", f"SELECT host, {SANITIZED} AS pattern, count(*) AS n_pages FROM (SELECT {HOST} AS host, {PATH} AS path FROM pages) GROUP BY ALL")
def u11_url_profile(spark, sf_dir):
    host, path, _ = U.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host"), U.sanitize_path(path).alias("pattern")).agg(F.count("*").alias("n_pages"))
