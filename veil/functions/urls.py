"""URL scoping: which segments name a record, path patterns, scopes and origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import identity

_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Hosts whose addresses name documents.
DOC_HOSTS = ["drive.google.com", "docs.google.com", "app.hubspot.com"]
DOC_DOMAINS = ["sharepoint.com", "dropbox.com", "box.com", "notion.so"]


def is_id_like_segment(s: Column) -> Column:
    return s.rlike(rf"^(?:[0-9]+|{_UUID}|[0-9a-fA-F]{{8,}}|[A-Z]{{1,3}}-?[0-9]{{4,}})\z")


def is_doc_id_segment(s: Column) -> Column:
    long = (F.length(s) >= 16) & s.rlike(r"^[A-Za-z0-9_-]+\z")
    hexed = s.rlike(rf"^(?:{_UUID}|[0-9a-fA-F]+)\z")
    slug = s.rlike(r"^[a-z]+(?:[-_][a-z]+)*\z")
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    cased = (F.length(F.regexp_replace(s, "[^A-Z]", "")) >= 3) & s.rlike("[a-z]") & ~s.rlike("[-_]")
    return long & (hexed | (~slug & (mixed | cased)))


def split_path(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def join_path(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def normalize_path(path: Column) -> Column:
    return join_path(split_path(path))


def _general(segments: Column) -> Column:
    def one(s: Column) -> Column:
        named = is_id_like_segment(s) | is_doc_id_segment(s) | s.rlike("[0-9]{4,}")
        return F.when(s.isin("*", "**"), s).when(named, "*").otherwise(s)

    return F.transform(segments, one)


def sanitize_path(path: Column) -> Column:
    return join_path(_general(split_path(path)))


def prefix_pattern(path: Column) -> Column:
    segments = split_path(path)
    parent = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.when(F.size(segments) <= 1, "/**").otherwise(F.concat(join_path(_general(parent)), F.lit("/**")))


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as an anchored regex over a normalised path: * is one segment, ** the rest."""
    before = F.regexp_extract(normalize_path(pattern), r"^(.*?)(?:/\*\*(?:/.*)?)?\z", 1)
    quoted = F.regexp_replace(before, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    starred = F.regexp_replace(quoted, r"(?<=/)\*(?=/|\z)", "[^/]+")
    rest = F.concat(F.lit("/"), normalize_path(pattern), F.lit("/"))
    exact = F.when(starred.isin("", "/"), F.lit(r"/?\z")).otherwise(F.concat(starred, F.lit(r"\z")))
    return F.concat(F.lit("^"), F.when(rest.contains("/**/"), F.concat(F.regexp_replace(starred, r"/\z", ""), F.lit(r"(?:/.*)?\z"))).otherwise(exact))


def matches_path(pattern: Column, path: Column) -> Column:
    return F.regexp_like(normalize_path(path), pattern_regex(pattern))


def is_doc_host(host: Column) -> Column:
    h = F.lower(host)
    found = h.isin(DOC_HOSTS)
    for domain in DOC_DOMAINS:
        found = found | (h == domain) | h.endswith(f".{domain}")
    return found


def query_values(query: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, r"^[^=]*=?(.*)\z", 1)), F.lit("")))


def search_has_doc_id(query: Column) -> Column:
    return F.exists(query_values(query), is_doc_id_segment)


def default_scope_kind(host: Column, path: Column, query: Column) -> Column:
    exact = is_doc_host(host) | F.exists(split_path(path), is_doc_id_segment) | search_has_doc_id(query)
    return F.when(exact, "exact").otherwise("pattern")


def canonical_search(query: Column) -> Column:
    """The parameters sorted by name; those of one name keep their order."""
    pairs = F.filter(F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", ""), "&"), lambda p: p != "")
    placed = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("name"), i.alias("place"), p.alias("pair")))
    joined = F.array_join(F.transform(F.array_sort(placed), lambda x: x["pair"]), "&")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def parse_origin(url: Column) -> Column:
    """A bare http(s) origin, or null if the text is anything more."""
    t = F.trim(url)
    shaped = t.rlike(r"(?i)^https?://[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?(?::[0-9]{1,5})?/?\z")
    plain = F.lower(F.regexp_replace(t, r"/\z", ""))
    return F.when(shaped, F.regexp_replace(plain, r"^(http://.*):80\z|^(https://.*):443\z", "$1$2"))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of an address."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"\?([^#]*)", 1)


def make_scope(url: Column, kind: Column, key: bytes) -> Column:
    """Scope of a rule made at an address: a pattern, or the identity of the page (with its query if that names a document)."""
    _, path, query = url_parts(url)
    with_query = search_has_doc_id(query)
    page = F.concat(normalize_path(path), F.when(with_query, canonical_search(query)).otherwise(F.lit("")))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "pattern", sanitize_path(path)).alias("path_pattern"),
        F.when(kind == "exact", identity("path", page, key)).alias("path_hmac"),
        F.when(kind == "exact", with_query).alias("include_query"),
    )


def frame_descriptor(url: Column, depth: Column, key: bytes) -> Column:
    origin = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))
    _, path, _ = url_parts(url)
    return F.struct(
        depth.alias("depth"),
        F.when(depth > 0, F.concat(origin, sanitize_path(path))).alias("url_pattern"),
        F.when(depth > 0, identity("frame", F.concat(origin, normalize_path(path)), key)).alias("url_hmac"),
    )


# Hosts (with a pattern of the path) of applications that draw their text.
CANVAS_APPS = [
    ("docs.google.com", r"^/(?:document|presentation|spreadsheets)(?:/|\z)"), ("www.figma.com", None), ("excalidraw.com", None), ("miro.com", None), ("lucid.app", None),
]


def known_canvas_app(host: Column, path: Column) -> Column:
    found = F.lit(False)
    for h, p in CANVAS_APPS:
        found = found | ((F.lower(host) == h) & (path.rlike(p) if p else F.lit(True)))
    return found


def classify_rendering(canvas_share: Column, text_chars: Column) -> Column:
    return F.when((canvas_share >= 0.4) & (text_chars < 300), "canvas").when(canvas_share >= 0.15, "mixed").otherwise("dom")
