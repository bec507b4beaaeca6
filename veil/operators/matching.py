"""Matches with offsets, spans that veto them, and spans on intervals.

Offsets are code points, 0-based, end-exclusive. Matches stay arrays of structs until the last step, so
detection and redaction of flat text are one projection. Work is in proportion to a text's length and matches: places of a long text are
read from its pieces, as reading at a place of a text steps over all characters before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import quoted, sql_of

SPAN = "array<struct<start: int, end: int>>"
MATCH = "array<struct<start: int, end: int, text: string>>"


#: Matches that one inner pass numbers; longer lists are numbered piece by piece, so that no list grows one by one.
PIECE = 64
#: Code points of one piece of a text.
REACH = 256
#: Sorted lists up to this length are searched from their start.
FEW = 16


def pieces(text: str) -> str:
    """SQL of a text as pieces of REACH code points."""
    return f"if(length({text}) <= {REACH}, array({text}), regexp_extract_all({text}, '(?s).{{1,{REACH}}}', 0))"


def part(p: str, start: str, size: str) -> str:
    """SQL of so many code points of a text at a place, from its pieces ``p`` (SQL of a name)."""
    some = f"slice({p}, cast(({start}) div {REACH} as int) + 1, cast((({start}) % {REACH} + ({size}) + {REACH - 1}) div {REACH} as int))"
    return f"if(size({p}) = 1, substring({p}[0], ({start}) + 1, {size}), substring(array_join({some}, ''), ({start}) % {REACH} + 1, {size}))"


def count_below(values: str, x: str) -> str:
    """SQL of how many of some sorted values are below x, by binary search where they are many."""
    steps = f"transform(sequence(cast(floor(log2(size({values}))) as int), 0, -1), b -> shiftleft(1, b))"
    search = f"aggregate({steps}, 0, (at_, step_) -> if(at_ + step_ <= size({values}) and {values}[at_ + step_ - 1] < {x}, at_ + step_, at_))"
    return f"if(size({values}) <= {FEW}, size(filter({values}, v_ -> v_ < {x})), {search})"


def pieces_of(text: Column) -> Column:
    """pieces() of a column."""
    return F.when(F.length(text) <= REACH, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REACH}}}"), F.lit(0)))


def part_of(p: Column, start: Column, size: Column) -> Column:
    """part() of columns."""
    first, within = F.floor(start / REACH).cast("int"), start % REACH
    some = F.slice(p, first + 1, F.ceil((within + size) / REACH).cast("int"))
    return F.when(F.size(p) == 1, F.substring(F.get(p, F.lit(0)), start + 1, size)).otherwise(F.substring(F.array_join(some, ""), within + 1, size))


def count_below_of(values: Column, x: Column) -> Column:
    """count_below() of columns."""
    n = F.size(values)
    steps = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    search = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(values, at + s - 1) < x), at + s).otherwise(at))
    return F.when(n <= FEW, F.size(F.filter(values, lambda v: v < x))).otherwise(search)


def matches_sql(text: str, pattern: str, need: str | None = None) -> str:
    """SQL of all non-overlapping matches, in order, of a pattern that never matches the empty string.

    text: SQL of a text; need: SQL of a cheap test without which no match is possible. Written as SQL because
    the whole expression is then one call from Python, and the text's gaps and hits are found once.
    A match begins after all gaps and matches before it.
    """
    p = quoted(pattern)
    step = "(a, x) -> named_struct('at', a.at + x.gap + length(x.hit), 'out', array_append(a.out, named_struct('start', a.at + x.gap, 'end', a.at + x.gap + length(x.hit), 'text', x.hit)))"
    piece = f"aggregate(slice(z, c + 1, {PIECE}), named_struct('at', acc.at, 'out', cast(array() as {MATCH})), {step})"
    return f"""if({need or "true"} and rlike({text}, {p}),
      transform(array(named_struct('hits', regexp_extract_all({text}, {p}, 0), 'gaps', split({text}, {p}, -1))), s ->
        transform(array(transform(s.hits, (h, i) -> named_struct('gap', length(s.gaps[i]), 'hit', h))), z ->
          flatten(aggregate(sequence(0, size(z) - 1, {PIECE}), named_struct('at', 0, 'out', cast(array() as array<{MATCH}>)),
            (acc, c) -> transform(array({piece}), r -> named_struct('at', r.at, 'out', array_append(acc.out, r.out)))[0]).out))[0])[0],
      cast(array() as {MATCH}))"""


def match_all(text: Column, pattern: str) -> Column:
    """matches_sql as a column, of a column that SQL can name."""
    return F.expr(matches_sql(sql_of(text), pattern))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def continues(text: str, start: str, end: str, p: str | None = None) -> str:
    """SQL: the number goes on past the match, with a dash or dot and a digit beside it. p: the text's pieces."""
    cut = (lambda at, n: part(p, at, n)) if p else (lambda at, n: f"substring({text}, {at} + 1, {n})")
    before = f"if({start} >= 2, {cut(f'{start} - 2', '2')}, '')"
    return f"(rlike({cut(end, '2')}, '^[-.][0-9]') or rlike({before}, '^[0-9][-.]'))"


def around(text: str, start: str, end: str, reach: int = 60, p: str | None = None) -> str:
    """SQL of the text beside a match, without it. p: the text's pieces."""
    cut = (lambda at, n: part(p, at, n)) if p else (lambda at, n: f"substring({text}, {at} + 1, {n})")
    return f"concat({cut(f'greatest({start} - {reach}, 0)', f'least({start}, {reach})')}, ' / ', {cut(end, str(reach))})"


def merge_ranges(ranges: Column, length: Column) -> Column:
    """Ranges clamped to the text, sorted, those that overlap or touch made one.

    With starts and ends each sorted by itself, a merged range begins at the i-th start if the i ends before it are all
    below it, and so ends at the i-th end if the next start is above it: no list grows range by range.
    """
    clamp = lambda r, n: F.struct(F.greatest(r["start"], F.lit(0)).cast("int").alias("start"), F.least(r["end"], n).cast("int").alias("end"))
    clamped = once(length, lambda n: F.transform(ranges, lambda r: clamp(r, n)))
    kept = F.filter(clamped, lambda r: r["start"] < r["end"])
    return once(kept, lambda k: merged(k["start"], k["end"], lambda start: start, lambda end: end))


def merged(starts: Column, ends: Column, first: Callable[[Column], Column], last: Callable[[Column], Column]) -> Column:
    """Ranges with these starts and ends, made one where ``first`` of a start is not above ``last`` of the end before it."""

    def of(z: Column) -> Column:
        begin = F.filter(z["s"], lambda v, i: (i == 0) | (first(v) > last(F.get(z["e"], i - 1))))
        stop = F.filter(z["e"], lambda v, i: (i == F.size(z["e"]) - 1) | (first(F.get(z["s"], i + 1)) > last(v)))
        return F.arrays_zip(begin, stop).cast(SPAN)

    return once(F.struct(F.array_sort(starts).alias("s"), F.array_sort(ends).alias("e")), of)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)
