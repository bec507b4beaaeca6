"""Detection over flat text: validated matches, label evidence, acceptance, the best hit of each block."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import let, quoted
from ..functions.identity import identity
from .detectors import BUILTIN, EXEMPT, NEGATIVES, YEAR, Detector
from .matching import around, continues, count_below, matches_sql, part, pieces

POINTS = {"high": 3, "medium": 2, "low": 1}
#: Where it is asked for, a user's pattern sees so much of a block and gives so many matches.
TEXT_MOST, MATCHES_MOST = 50_000, 500
SUGGESTIONS_MOST = 200
#: Pairs of matches and look-alikes of a block that are compared one by one.
PAIRS_MOST = 4096

HITS = "array<struct<pattern: string, name: string, strength: string, bonus: int, score: int, ord: int, start: int, end: int>>"


def worth_scanning(text: Column, user: Iterable[Detector] = ()) -> Column:
    """Four digits for the built-ins; for others one digit, or anything if a pattern needs none."""
    enough = text.rlike("(?:[0-9][^0-9]*){4}")
    user = list(user)
    if not user:
        return enough
    needs = all("[0-9]" in d.pattern and "|" not in d.pattern.replace(r"\|", "") for d in user)
    return enough | (text.rlike("[0-9]") if needs else text.rlike(r"\S"))


def accepts(strength: Column, bonus: Column, sensitivity: str, gated: Column) -> Column:
    least = 1 if sensitivity == "aggressive" else 2
    if sensitivity == "labeled-only":
        enough = bonus >= 2
    elif sensitivity == "aggressive":
        enough = (strength != "low") | (bonus >= 1)
    else:
        enough = (strength == "high") | ((strength == "medium") & (bonus >= 1)) | ((strength == "low") & (bonus >= 2))
    return (~gated | (bonus >= least)) & enough


def strength_points(strength: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])[strength]


def negatives(text: str = "text") -> Column:
    """All vetoing spans of a text (SQL of it), with their names."""
    named = [f"transform({matches_sql(text, p)}, m -> named_struct('name', '{name}', 'start', m.start, 'end', m.end))" for name, p in NEGATIVES.items()]
    return F.expr(f"concat({', '.join(named)})")


def candidates(detectors: list[Detector], as_of_year: int = YEAR, text: str = "text", limited: bool = False) -> Column:
    """Valid matches of all detectors in a text (SQL of it), in the order of detectors: (ord, start, end, text).

    limited: keep catalogue and users' detectors to TEXT_MOST characters and MATCHES_MOST matches, as a browser does.
    """

    def of(d: Detector, place: int) -> str:
        bounded = f"substring({text}, 1, {TEXT_MOST})" if limited and d.asked else text
        found = matches_sql(bounded, d.pattern, f"contains({bounded}, {quoted(d.need)})" if d.need else None)
        found = f"slice({found}, 1, {MATCHES_MOST})" if limited and d.asked else found
        if d.validate is not None:
            found = f"filter({found}, m -> {d.valid('m.text', as_of_year)})"
        return f"transform({found}, m -> named_struct('ord', {place}, 'start', m.start, 'end', m.end, 'text', m.text))"

    return F.expr(f"concat({', '.join(of(d, i) for i, d in enumerate(detectors))})")


def by_detector(detectors: list[Detector], place: str, of: Callable[[Detector], str], otherwise: str) -> str:
    """SQL of what ``of`` says of the detector at a place."""
    return f"case {place} {' '.join(f'when {i} then {of(d)}' for i, d in enumerate(detectors))} else {otherwise} end"


def least_bonus(d: Detector, sensitivity: str) -> int:
    """The label evidence that a detector's matches need: the least bonus that accepts() takes."""
    by_strength = {"labeled-only": {}, "aggressive": {"low": 1, "medium": 0, "high": 0}, "balanced": {"low": 2, "medium": 1, "high": 0}}[sensitivity].get(d.strength, 2)
    return max(by_strength, (1 if sensitivity == "aggressive" else 2) if d.gated else 0)


def facts(detectors: list[Detector]) -> str:
    """SQL of what is fixed of each detector, in their order."""
    one = lambda d: f"named_struct('pattern', {quoted(d.shown_id)}, 'name', {quoted(d.name)}, 'strength', '{d.strength}', 'points', {POINTS[d.strength]})"
    return f"array({', '.join(map(one, detectors))})"


def standing(detectors: list[Detector], text: str = "text") -> Column:
    """The column ``found`` without what goes on or is vetoed (``negs``). Catalogue's and users' are not vetoed by look-alikes.

    Look-alikes of one name never overlap one another, so where there are many the last that begins before a match's
    end is searched, of each name.
    """
    asked = [i for i, d in enumerate(detectors) if d.asked]
    catalog = [i for i, d in enumerate(detectors) if d.catalog]
    tests = [f"not {continues(text, 'm.start', 'm.end', 'p')}"]
    if catalog:
        tests.append(f"(m.ord not in ({', '.join(map(str, catalog))}) or not {T.is_tracking('m.text', part('p', 'greatest(m.start - 40, 0)', 'least(m.start, 40)'))})")
    kept = f"filter(found, m -> {' and '.join(tests)})"
    if len(asked) < len(detectors):
        free = f"m.ord in ({', '.join(map(str, asked))}) or " if asked else ""
        exempt = {name: ", ".join(str(i) for i, d in enumerate(detectors) if d.id in ids) for name, ids in EXEMPT.items()}
        met = "n.start < m.end and n.end > m.start" + "".join(f" and not (n.name = '{name}' and m.ord in ({places}))" for name, places in exempt.items() if places)
        plain = f"filter(kept, m -> {free}not exists(negs, n -> {met}))"
        by_name = ", ".join(f"'{name}', filter(negs, n -> n.name = '{name}')" for name in NEGATIVES)
        starts = ", ".join(f"'{name}', z.{name}.start" for name in NEGATIVES)
        hit = lambda name: let(count_below(f"s.{name}", "m.end"), "k", f"k > 0 and z.{name}[k - 1].end > m.start")
        of_name = lambda name: f"({hit(name)}{f' and m.ord not in ({exempt[name]})' if exempt.get(name) else ''})"
        searched = f"filter(kept, m -> {free}not ({' or '.join(map(of_name, NEGATIVES))}))"
        many = let(f"named_struct({by_name})", "z", let(f"named_struct({starts})", "s", searched))
        kept = let(kept, "kept", f"if(size(kept) * size(negs) <= {PAIRS_MOST}, {plain}, {many})")
    return F.expr(let(pieces(text), "p", kept))


def with_matches(texts: DataFrame, detectors: list[Detector], enough: Column, as_of_year: int = YEAR, text: str = "text", limited: bool = False) -> DataFrame:
    """texts with ``found``: validated candidates where ``enough`` holds, else an empty list. Look-alikes are searched only beside candidates."""
    none = F.expr("cast(array() as array<struct<ord: int, start: int, end: int, text: string>>)")
    ready = texts.withColumn("found", F.when(enough, candidates(detectors, as_of_year, text, limited)).otherwise(none))
    vetoes = not all(d.asked for d in detectors)
    ready = ready.withColumn("negs", F.when((F.size("found") > 0) & vetoes, negatives(text)))
    return ready.withColumn("found", F.when(F.size("found") > 0, standing(detectors, text)).otherwise(none)).drop("negs")


def find_matches(texts: DataFrame, detectors: Iterable[Detector] = BUILTIN, as_of_year: int = YEAR, limited: bool = False) -> DataFrame:
    """texts (…, text) with ``matches``: every validated match as (pattern, strength, start, end)."""
    detectors = list(detectors)
    enough = F.lit(True) if any(d.asked for d in detectors) else F.col("text").rlike("[0-9]")
    known = ", ".join(f"named_struct('pattern', {quoted(d.id)}, 'strength', '{d.strength}')" for d in detectors)
    made = f"transform(found, m -> named_struct('pattern', array({known})[m.ord].pattern, 'strength', array({known})[m.ord].strength, 'start', m.start, 'end', m.end))"
    found = with_matches(texts, detectors, F.coalesce(enough, F.lit(False)), as_of_year, limited=limited)
    return found.withColumn("matches", F.expr(made)).drop("found")


def named(d: Detector, label: str) -> str:
    """SQL: does a normalised label name what the detector looks for?"""
    return f"coalesce(rlike({label}, {quoted(d.naming)}), false)" if d.naming else "false"


def hits_of(detectors: list[Detector], sensitivity: str) -> Column:
    """The accepted hits of the column ``found`` in flat text, where the block is the element.

    Label evidence is 3 in a short block, 1 nearby, else 0.
    """
    rest = "concat(substring(text, 1, m.start), ' ', substring(text, m.end + 1, x.n))"
    said = f"named_struct('own', if(x.n <= 3 * (m.end - m.start) + 40, {T.label_sql(rest)}, null), 'near', {T.label_sql(around('text', 'm.start', 'm.end', p='x.p'))})"
    bonus = by_detector(detectors, "m.ord", lambda d: f"case when {named(d, 's.own')} then 3 when {named(d, 's.near')} then 1 else 0 end" if d.naming else "0", "0")
    graded = f"transform(found, m -> named_struct('m', m, 'bonus', {let(said, 's', bonus)}, 'fact', {facts(detectors)}[m.ord]))"
    least = f"array({', '.join(str(least_bonus(d, sensitivity)) for d in detectors)})"
    hit = "named_struct('pattern', g.fact.pattern, 'name', g.fact.name, 'strength', g.fact.strength, 'bonus', g.bonus, 'score', g.bonus + g.fact.points, 'ord', g.m.ord, 'start', g.m.start, 'end', g.m.end)"
    return F.expr(let(f"named_struct('p', {pieces('text')}, 'n', length(text))", "x", f"transform(filter({graded}, g -> g.bonus >= {least}[g.m.ord]), g -> {hit})"))


def detect(
    texts: DataFrame, sensitivity: str = "balanced", detectors: Iterable[Detector] = BUILTIN, keep: str = "best", as_of_year: int = YEAR
) -> DataFrame:
    """texts (doc_key, block_id, text, …) with ``hits`` as HITS; keep='best' leaves one hit of each block, 'all' every one."""
    detectors = sorted(detectors, key=lambda d: not d.asked)
    text = F.col("text")
    enough = F.coalesce(worth_scanning(text, [d for d in detectors if d.asked]), F.lit(False))
    found = with_matches(texts, detectors, enough, as_of_year)
    found = found.withColumn("hits", F.when(F.size("found") > 0, hits_of(detectors, sensitivity)).otherwise(F.array().cast(HITS))).drop("found")
    if keep == "best":
        ranked = F.transform("hits", lambda h: F.struct((-h["score"]).alias("r"), h["ord"].alias("o"), h["start"].alias("s"), h.alias("h")))
        found = found.withColumn("hits", F.transform(F.slice(F.array_sort(ranked), F.lit(1), F.lit(1)), lambda x: x["h"]))
    return found


def exploded(found: DataFrame) -> DataFrame:
    """One row for each hit, without the text.

    An outer explode, as a plain one makes the optimizer test the hits below it, which finds them twice.
    """
    return found.select("doc_key", "block_id", F.explode_outer("hits").alias("h")).where("h is not null").select("doc_key", "block_id", "h.*")


def suggestions(hits: DataFrame, dismissed: DataFrame, key: bytes, most: int = SUGGESTIONS_MOST) -> DataFrame:
    """Hits (doc_key, block_id, pattern, name, score, start, label) as identities, without dismissed ones.

    An id that comes twice keeps its higher score, the later of equals; the first ``most`` of a document stay;
    ``total`` counts the document's hits before dismissal. dismissed: (id).
    """
    from pyspark.sql import Window

    path = F.concat_ws("/", F.col("doc_key"), F.col("block_id").cast("string"))
    named = hits.withColumn("id", identity("suggest", F.concat_ws("|", "pattern", path, F.coalesce("label", F.lit(""))), key))
    named = named.withColumn("total", F.count("*").over(Window.partitionBy("doc_key")))
    left = named.join(dismissed.select("id").distinct(), "id", "left_anti")
    best = Window.partitionBy("doc_key", "id").orderBy(F.desc("score"), F.desc("block_id"), F.desc("start"))
    once = left.withColumn("n", F.row_number().over(best)).where("n = 1")
    order = Window.partitionBy("doc_key").orderBy("block_id", "start", "pattern")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("doc_key", "id", "pattern", "name", "score", "place", "total")
