"""Text, label and token functions: columns of built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import B, WS, quoted
from .dialect import let as sql_let
from .validators import digits

KINDS = ["ssn", "ein", "account", "routing", "card", "dob", "id"]
# The words that name each kind of label.
KIND_WORDS = {
    "ssn": r"ssns?|social security|soc sec|tax ?id|taxpayer|tins?|itins?",
    "ein": r"eins?|employer id(?:entification)?(?: number| no)?|feins?|tax ?id|tins?",
    "account": r"account (?:number|no|num)|accounts?|acct|bank account|iban|swift|bic",
    "routing": r"routing|aba|rtn",
    "card": r"card (?:number|no|num)|credit card|debit(?: card)?|cc ?number|cc num",
    "dob": r"date of birth|dob|birth ?date|bday|birthday",
    "id": r"passport|drivers? ?s? licen[cs]e|driver licen[cs]e|licen[cs]e (?:number|no)",
}
AUTOCOMPLETE = {"cc-number": "card", "cc-csc": "card", "bday": "dob", "bday-day": "dob", "bday-month": "dob", "bday-year": "dob"}
NAMING_ATTRIBUTES = ["name", "id", "placeholder", "aria-label", "title", "data-label"]


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, f"[{WS}]+", " "))


def normalize_text(s: Column) -> Column:
    return F.lower(collapse(s))


def normalize_context(s: Column, most: int = 40) -> Column:
    letters = F.regexp_replace(F.regexp_replace(F.lower(s), r"\p{Nd}+", " "), r"[^\p{L}]+", " ")
    return F.nullif(F.substring(F.trim(letters), 1, most), F.lit(""))


#: What a label goes through to a-z and single spaces: pattern and replacement, in lower case after the first.
_LABEL_STEPS = [("([a-z])([A-Z])", "$1 $2"), ("#", " number "), ("['’]", ""), ("[^a-z]+", " ")]


def normalize_label(s: Column) -> Column:
    for i, (pattern, by) in enumerate(_LABEL_STEPS):
        s = F.regexp_replace(F.lower(s) if i == 1 else s, pattern, by)
    return F.trim(s)


def label_sql(s: str) -> str:
    """normalize_label as SQL."""
    for i, (pattern, by) in enumerate(_LABEL_STEPS):
        s = f"regexp_replace({f'lower({s})' if i == 1 else s}, {quoted(pattern)}, {quoted(by)})"
    return f"trim({s})"


def normalize_label_words(s: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}]+", " ")), 1, 40)


def label_kinds(s: Column) -> Column:
    """The kinds that a label's words name, in the order of KINDS."""
    found = lambda t: F.array(*[F.when(t.rlike(rf"(?<![a-z])(?:{KIND_WORDS[k]})(?![a-z])"), k) for k in KINDS])
    return F.array_compact(let(normalize_label(F.coalesce(s, F.lit(""))), found))


def kind_pattern(wanted: list[str]) -> str:
    """Found in a normalised label that names any of these kinds: has_kind(label_kinds(s), wanted) in one pattern."""
    return rf"(?<![a-z])(?:{'|'.join(KIND_WORDS[k] for k in wanted)})(?![a-z])"


def phrase_pattern(phrases: list[str]) -> str | None:
    """Found in a normalised label that has any of these phrases as whole words; None if no phrase has a letter."""
    split = [re.sub("([a-z])([A-Z])", r"\1 \2", p).lower().replace("#", " number ") for p in phrases]
    words = [re.sub("[^a-z]+", " ", re.sub("['’]", "", p)).strip() for p in split]
    return rf"(?:^| )(?:{'|'.join(w for w in words if w)})(?: |\z)" if any(words) else None


def has_kind(kinds: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(kinds, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def input_kinds(attrs: Column) -> Column:
    """Kinds that the attributes (a map) of a form field name."""
    tokens = F.split(F.lower(F.coalesce(F.try_element_at(attrs, F.lit("autocomplete")), F.lit(""))), f"[{WS}]+")
    table = F.create_map(*[F.lit(x) for pair in AUTOCOMPLETE.items() for x in pair])
    named = F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, t)))
    said = F.flatten(F.transform(F.array(*map(F.lit, NAMING_ATTRIBUTES)), lambda a: label_kinds(F.try_element_at(attrs, a))))
    return F.array_distinct(F.concat(named, said))


def keyword_test(s: Column, phrases: Column) -> Column:
    """Does any phrase stand in the text as whole words? Both are compared in label form."""
    wanted = F.filter(F.transform(phrases, normalize_label), lambda p: p != "")
    padded = F.concat(F.lit(" "), normalize_label(F.coalesce(s, F.lit(""))), F.lit(" "))
    return let(padded, lambda text: F.exists(wanted, lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" ")))))


def tokens_of(s: Column) -> tuple[Column, Column]:
    """(words, digit runs) by which a text could be recognised elsewhere."""
    parts = F.filter(F.split(s, f"[{WS}]+"), lambda t: (F.length(t) >= 5) | ((F.length(t) >= 4) & t.rlike("[0-9]")))
    runs = F.filter(F.transform(F.split(s, f"[{WS}]+"), digits), lambda d: F.length(d) >= 6)
    return F.array_distinct(parts), F.array_distinct(runs)


def leaks(value: Column, words: Column, runs: Column) -> Column:
    return F.exists(words, lambda w: F.contains(value, w)) | F.exists(runs, lambda d: F.contains(digits(value), d))


def is_tracking(match: str, before: str) -> str:
    """SQL: a parcel number by its shape, or by the word in the 40 characters before it."""
    shapes = [r"(?i)^1Z[0-9A-Z]{16}\z", r"^(?:82|9[2-5])[0-9]{18,20}\z", r"^[A-Z]{2}[0-9]{9}[A-Z]{2}\z"]
    compact = f"regexp_replace({match}, {quoted(f'[{WS}-]')}, '')"
    shaped = sql_let(compact, "compact", " or ".join(f"rlike(compact, {quoted(p)})" for p in shapes))
    said = f"if(length({before}) > 40, substring({before}, -40, 40), {before})"
    word = quoted(f"(?i){B}(?:tracking|shipment|waybill){B}")
    return f"({shaped} or rlike({said}, {word}))"


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def doc_key(content: Column) -> Column:
    """A key for a document's bytes in letters only, so that no digit run can look like an identifier."""
    return F.concat(F.lit("/pdf/"), F.translate(F.substring(F.sha2(content, 256), 1, 16), "0123456789abcdef", "ghijklmnopqrstuv"))


def file_name_from_url(url: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*\z", "")
    last = F.regexp_extract(F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"([^/]*)/*\z", 1)
    return F.coalesce(F.nullif(F.coalesce(F.try_url_decode(last), last), F.lit("")), F.lit("document.pdf"))


def redacted_file_name(name: Column) -> Column:
    stem = F.regexp_replace(name, r"(?i)\.pdf\z", "")
    safe = F.trim(F.regexp_replace(stem, r'[\\/:*?"<>|\p{Cntrl}]+', "_"))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("document")), F.lit("-redacted.pdf"))


def looks_like_pdf_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*\z", "").rlike(r"(?i)^(?:https?|file)://.*\.pdf\z")


def parse_src(query: Column) -> Column:
    """The http(s) address in a viewer's ``src`` parameter, or null."""
    value = F.try_url_decode(F.nullif(F.regexp_extract(query, r"(?:^|[?&])src=([^&#]*)", 1), F.lit("")))
    return F.when(value.rlike(r"(?i)^https?://[^/\s]+"), value)


def fill_rects(rects: Column, scale: float, width: Column, height: Column) -> Column:
    """Boxes in device pixels, grown to whole pixels, clamped to the page; empty ones go."""

    def grow(r: Column) -> Column:
        x0, y0 = F.greatest(F.floor(r["x"] * scale), F.lit(0)), F.greatest(F.floor(r["y"] * scale), F.lit(0))
        x1, y1 = F.least(F.ceil((r["x"] + r["w"]) * scale), width), F.least(F.ceil((r["y"] + r["h"]) * scale), height)
        return F.struct(x0.cast("long").alias("x"), y0.cast("long").alias("y"), (x1 - x0).cast("long").alias("w"), (y1 - y0).cast("long").alias("h"))

    return F.filter(F.transform(rects, grow), lambda r: (r["w"] > 0) & (r["h"] > 0))


# Unicode letters, digits and underscore, for edits.
_EDGE = r"[\p{L}\p{N}_]"


def run_regex(original: str) -> str:
    """A pattern that finds a run of words whatever white space is between them."""
    words = [re.sub(r"([\\^$.*+?()\[\]{}|/-])", r"\\\1", w) for w in re.split(r"\s+", original.strip()) if w]
    body = f"[{WS}]+".join(words)
    first, last = original.strip()[:1], original.strip()[-1:]
    edge = lambda c: c.isalnum() or c == "_"
    return (f"(?<!{_EDGE})" if edge(first) else "") + body + (f"(?!{_EDGE})" if edge(last) else "")


def changed_run(before: str, after: str) -> tuple[str, str] | None:
    """What of a text changed, in whole words: (original, now), or None if only white space did."""
    a, b = re.sub(r"\s+", " ", before).strip(), re.sub(r"\s+", " ", after).strip()
    if a == b:
        return None
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    while start > 0 and not a[start - 1].isspace():
        start -= 1
    while stop > 0 and not a[len(a) - stop].isspace():
        stop -= 1
    return a[start : len(a) - stop].strip(), b[start : len(b) - stop].strip()
