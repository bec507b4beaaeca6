"""Pattern teaching: shapes of examples, templates, regex checks, and search in the catalogue."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import WS
from ..functions.text import normalize_label_words
from .ambiguity import TooLarge, ambiguity, repeated_shapes
from .detectors import BUILTIN_ENTRIES, CATALOG, Detector, custom

EXAMPLE_MOST, RUN_MOST, REGEX_MOST, TEMPLATE_MOST = 64, 12, 200, 60
UNITS = "array<struct<cls: string, lit: string, min: int, max: int>>"
_CLASSES = {"digit": r"\d", "upper": "[A-Z]", "lower": "[a-z]", "alpha": "[A-Za-z]", "alnum": "[A-Za-z0-9]", "any": "."}
_NOUNS = {"digit": "digit", "upper": "letter", "lower": "lowercase letter", "alpha": "letter", "alnum": "letter or digit", "any": "character"}
_SPACES = f"[{WS}]+"


def shape_of(text: Column, label: Column | None = None) -> Column:
    """Runs of digits, letters and separators of an example, its label dropped from the front."""
    t = F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")
    if label is not None:
        words = F.filter(F.split(normalize_label_words(F.coalesce(label, F.lit(""))), " "), lambda w: w != "")
        front = F.concat(F.lit("(?i)^(?:(?:"), F.array_join(words, "|"), F.lit(rf")(?![\p{{L}}])[{WS}:#.]*)+(?=.)"))
        t = F.when(F.size(words) > 0, F.regexp_replace(t, front, F.lit(""))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, rf"^[:#,;]+[{WS}]*", ""), rf"[{WS}]*[.,;:]+\z", "")
    mixed = t.rlike("[A-Z]") & t.rlike("[a-z]")
    runs = F.regexp_extract_all(t, F.lit(rf"\p{{Nd}}+|[A-Z]+|[a-z]+|[\p{{L}}&&[^A-Za-z]]+|[{WS}]+|(.)\1*"), 0)

    def unit(r: Column) -> Column:
        n = F.length(r)
        cls = (
            F.when(r.rlike(r"^\p{Nd}"), "digit").when(r.rlike("^[A-Z]"), F.when(mixed, "alpha").otherwise("upper"))
            .when(r.rlike("^[a-z]"), F.when(mixed, "alpha").otherwise("lower")).when(r.rlike(r"^\p{L}"), "alpha").otherwise("sep")
        )
        space = r.rlike(f"^[{WS}]")
        lit = F.when(cls == "sep", F.when(space, " ").otherwise(F.substring(r, 1, 1)))
        return F.struct(cls.alias("cls"), lit.alias("lit"), F.when(space, 1).otherwise(n).alias("min"), F.when(space, 1).otherwise(n).alias("max"))

    def join(acc: Column, u: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (last["cls"] == u["cls"]) & (u["cls"] != "sep")
        grown = F.struct(last["cls"].alias("cls"), last["lit"].alias("lit"), (last["min"] + u["min"]).alias("min"), (last["max"] + u["max"]).alias("max"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(u)))

    merged = F.aggregate(F.transform(runs, unit), F.array().cast(UNITS), join)

    def widen(u: Column) -> Column:
        long = (u["cls"] != "sep") & (u["min"] > RUN_MOST)
        return F.struct(u["cls"].alias("cls"), u["lit"].alias("lit"), F.when(long, u["min"] - 1).otherwise(u["min"]).alias("min"), F.when(long, u["max"] + 1).otherwise(u["max"]).alias("max"))

    return F.transform(merged, widen)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _literal(u: Column) -> Column:
    """Is a unit a letter or digit that stands for itself, such as a format's fixed prefix?"""
    return (u["cls"] == "sep") & u["lit"].rlike(r"^[\p{L}\p{N}]\z")


def units_to_regex(units: Column) -> Column:
    """Classes and literals with their counts; a unit without ``max`` is open. Word boundaries at alphanumeric ends."""

    def one(u: Column) -> Column:
        escaped = F.regexp_replace(u["lit"], r"([\\^$.*+?()\[\]{}|/])", r"\\$1")
        lit = F.when(u["lit"] == " ", r"[  ]").when(u["lit"].rlike("[‐-―−]"), r"[-‐-―]").otherwise(escaped)
        once = (u["min"] == 1) & F.coalesce(u["max"] == 1, F.lit(False))
        grouped = F.when(once | (F.length(lit) == 1) | lit.startswith("["), lit).otherwise(F.concat(F.lit("(?:"), lit, F.lit(")")))
        body = F.when(u["cls"] == "sep", grouped).otherwise(_table(_CLASSES)[u["cls"]])
        low, high = u["min"].cast("string"), u["max"].cast("string")
        many = F.when(u["max"].isNull() & (u["min"] == 0), "*").when(u["max"].isNull() & (u["min"] == 1), "+").when(u["max"].isNull(), F.concat(F.lit("{"), low, F.lit(",}")))
        many = many.when(once, "").when(u["min"] == u["max"], F.concat(F.lit("{"), low, F.lit("}")))
        return F.concat(body, many.otherwise(F.concat(F.lit("{"), low, F.lit(","), high, F.lit("}"))))

    edge = lambda u: F.when((~u["cls"].isin("sep", "any") | _literal(u)) & (u["min"] > 0), r"\b").otherwise("")
    whole = F.concat(edge(units[0]), F.array_join(F.transform(units, one), ""), edge(F.element_at(units, -1)))
    return F.when(F.size(units) > 0, whole).otherwise("")


def describe_units(units: Column) -> Column:
    """In words: counts of each class in order, fixed letters and digits in quotes."""

    def counted(u: Column) -> Column:
        noun = _table(_NOUNS)[u["cls"]]
        many = F.when(u["cls"] == "alnum", "letters or digits").otherwise(F.concat(noun, F.lit("s")))
        low, high = u["min"].cast("string"), u["max"].cast("string")
        open_ = F.when(u["min"] == 0, F.concat(F.lit("any number of "), many)).otherwise(F.concat(low, F.lit(" or more "), many))
        closed = F.when(u["min"] == u["max"], F.concat(low, F.lit(" "), F.when(u["min"] == 1, noun).otherwise(many)))
        return F.when(u["max"].isNull(), open_).otherwise(closed.otherwise(F.concat(low, F.lit("–"), high, F.lit(" "), many)))

    def said(acc: Column) -> Column:
        return F.when(acc["fixed"] != "", F.array_append(acc["parts"], F.concat(F.lit('"'), acc["fixed"], F.lit('"')))).otherwise(acc["parts"])

    def step(acc: Column, u: Column) -> Column:
        parts = F.when(_literal(u), acc["parts"]).when(u["cls"] == "sep", said(acc)).otherwise(F.array_append(said(acc), counted(u)))
        fixed = F.when(_literal(u), F.concat(acc["fixed"], F.repeat(u["lit"], u["min"]))).otherwise("")
        return F.struct(parts.alias("parts"), fixed.alias("fixed"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("fixed"))
    return F.aggregate(units, start, step, lambda acc: F.when(F.size(said(acc)) > 0, F.array_join(said(acc), ", ")).otherwise("separators only"))


def strength_of(units: Column) -> Column:
    body = F.filter(units, lambda u: u["cls"] != "sep")
    chars = F.aggregate(units, F.lit(0), lambda a, u: a + u["min"])
    digits_only = F.forall(body, lambda u: u["cls"] == "digit")
    letters_only = F.forall(body, lambda u: u["cls"].isin("upper", "lower", "alpha"))
    classes = F.array_join(F.transform(units, lambda u: F.when(u["cls"] == "sep", "s").otherwise("b")), "")
    inside = classes.rlike("b.*s.*b")
    low = (F.size(body) == 0) | (digits_only & (chars <= 6)) | letters_only
    return F.when(low, "low").when((chars >= 9) & inside & (F.size(body) >= 2), "high").otherwise("medium")


def derive_from_example(examples: DataFrame) -> DataFrame:
    """examples (example, label) with regex, description, strength, labels, or error.

    The regex has no character of the example but separators.
    """
    text = F.trim(F.regexp_replace("example", _SPACES, " "))
    ready = examples.withColumn("units", shape_of(text, F.col("label")))
    body = F.filter("units", lambda u: u["cls"] != "sep")
    chars = F.aggregate(body, F.lit(0), lambda a, u: a + u["min"])
    error = (
        F.when(text == "", "empty").when(F.length(text) > EXAMPLE_MOST, "too long").when(F.size(body) == 0, "no letters or digits").when(chars < 3, "too short")
    )
    words = F.nullif(normalize_label_words(F.coalesce("label", F.lit(""))), F.lit(""))
    good = error.isNull()
    return ready.select(
        *examples.columns, error.alias("error"), F.when(good, units_to_regex(F.col("units"))).alias("regex"), F.when(good, describe_units(F.col("units"))).alias("description"),
        F.when(good, strength_of(F.col("units"))).alias("strength"), F.when(good, F.array_compact(F.array(words))).alias("labels"),
    )


def template_to_regex(template: str) -> str:
    """``# A a X ? *`` stand for classes, a backslash before a character for itself; digits mean any digit."""
    if not 0 < len(template) <= TEMPLATE_MOST:
        raise ValueError("a template has 1 to 60 characters")
    symbols = {"#": r"\d", "A": "[A-Z]", "a": "[a-z]", "X": "[A-Za-z0-9]", "?": ".", "*": "*"}
    units: list[list] = []
    chars = iter(template)
    for c in chars:
        if c == "\\":
            c = next(chars, None)
            if c is None:
                raise ValueError("a template cannot end in a backslash")
            body = re.escape(c)
        elif c == "*":
            if not units:
                raise ValueError("a template cannot begin with *")
            units[-1][1] = None
            continue
        else:
            body = symbols.get(c) or (r"\d" if c.isdigit() else r"[  ]" if c == " " else re.escape(c).replace(r"\-", "-"))
        if units and units[-1][0] == body and units[-1][1] is not None:
            units[-1][1] += 1
        else:
            units.append([body, 1])
    out = "".join(body + ("+" if n is None else "" if n == 1 else f"{{{n}}}") for body, n in units)
    plain = lambda body: body in (r"\d", "[A-Z]", "[a-z]", "[A-Za-z0-9]") or body.isalnum()
    return (r"\b" if plain(units[0][0]) else "") + out + (r"\b" if plain(units[-1][0]) else "")


@dataclass(frozen=True)
class Checked:
    ok: bool
    reason: str = ""


def check_regex(source: str, flags: str = "") -> Checked:
    """Static rules for users' patterns: they compile, cannot match nothing, hold no data, and read no text in too many ways (ambiguity)."""
    if not source or len(source) > REGEX_MOST:
        return Checked(False, "length")
    if not re.fullmatch("[iu]{0,2}", flags):
        return Checked(False, "flags")
    bare = re.sub(r"\\\\", "", source)
    if re.search(r"\\[1-9]|\\k<|\(\?P=", bare):
        return Checked(False, "backreference")
    if re.search(r"(?<![\\{,\d])\d{4,}", re.sub(r"\{\d+(?:,\d*)?\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}", "", bare)):
        return Checked(False, "literal digits")
    try:
        compiled = re.compile(source, re.ASCII)
        if shape := repeated_shapes(source):
            return Checked(False, shape)
        if slow := ambiguity(source, "i" in flags):
            return Checked(False, f"{slow} time")
    except re.error:
        return Checked(False, "syntax")
    except TooLarge:
        return Checked(False, "size")
    return Checked(False, "empty match") if compiled.match("") else Checked(True)


def compile_detectors(rows: DataFrame) -> list[Detector]:
    """Runnable detectors of a small table (at most 50 for a site); unsafe patterns are left out."""
    out = []
    for r in rows.select("id", "name", "regex", "flags", "labels", "strength").collect():
        if check_regex(r["regex"] or "", r["flags"] or "").ok:
            out.append(custom(r["id"], r["name"], r["regex"], r["flags"], list(r["labels"] or []), r["strength"] or "low"))
    return out


def _stems(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", " ")
    parts = F.filter(F.split(F.trim(plain), " "), lambda w: w != "")

    def stem(w: Column) -> Column:
        w = F.regexp_replace(F.regexp_replace(w, "licence", "license"), r"ies\z", "y")
        return F.regexp_replace(F.regexp_replace(w, r"(?<!s)s\z", ""), r"e\z", "")

    return F.transform(parts, stem)


#: Words that stand in most names and tell none apart.
STOP = "a an and at by for in of on or the to with number numbers id code someone"


def catalog_words() -> list[tuple[int, str, str]]:
    """(number, entry, phrase) of all that a search can find."""
    names = [(e, [*words, name]) for e, (name, _, words) in BUILTIN_ENTRIES.items()] + [(d.id, [*d.synonyms, d.name]) for d in CATALOG]
    return [(n, e, phrase) for n, (e, phrases) in enumerate(names) for phrase in phrases]


def find_catalog(queries: DataFrame) -> DataFrame:
    """(query, entry, score, place): catalogue entries for free text, best first. The catalogue is of fixed size."""
    spark = queries.sparkSession
    entries = spark.createDataFrame(catalog_words(), "n int, entry string, synonym string")
    stop = F.array(*map(F.lit, [re.sub("e$", "", re.sub("(?<!s)s$", "", w)) for w in STOP.split()]))
    words = entries.select("n", "entry", F.array_sort(F.array_except(_stems(F.col("synonym")), stop)).alias("means")).where(F.size("means") > 0)
    asked = queries.select("query", _stems(F.col("query")).alias("q"))
    pairs = asked.select("query", "q", F.explode("q").alias("w")).distinct().join(F.broadcast(words.withColumn("w", F.explode("means"))), "w").select("query", "q", "n", "entry", "means").distinct()
    full = F.size(F.array_intersect("means", "q")) == F.size(F.array_distinct("means"))
    scored = pairs.groupBy("query", "n", "entry").agg(F.sum(F.when(full, 2 * F.size("means")).otherwise(1)).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "n"))
    return scored.select("query", "entry", "score", place.alias("place"))


