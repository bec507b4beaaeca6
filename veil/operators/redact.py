"""Redaction: length-preserving bullets over ranges, and exact restoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import WS
from .detect import detect
from .detectors import BUILTIN, YEAR, Detector
from .matching import SPAN, count_below_of, match_all, merge_ranges, merged, once, part_of, pieces_of

BULLET = "•"
ELEMENT_MOST, STICKERS_MOST = 2000, 200
# Attributes that show text to a reader, and those that a token may stay in.
SHOWN = ["title", "alt", "aria-label", "aria-description", "placeholder", "data-tooltip", "data-title"]
IDENTITY = ["id", "class", "style", "name", "for", "type", "role", "href", "src", "tabindex", "data-key", "data-id", "data-row-id", "data-rowid", "data-uid", "data-record-id", "data-item-id", "key"]


def bullets(s: Column) -> Column:
    return F.regexp_replace(s, f"[^{WS}]", BULLET)


def is_bullets(s: Column) -> Column:
    return s.rlike(rf"^[{WS}{BULLET}]*\z") & s.contains(BULLET)


def mask_value(s: Column) -> Column:
    return F.repeat(F.lit(BULLET), F.length(s))


def redact_ranges(text: Column, ranges: Column) -> Column:
    """Bullets inside the ranges, the rest as it was; the length stays. One join of what stands before each range and its bullets."""

    def joined(x: Column) -> Column:
        p, r = x["p"], x["r"]
        stop = lambda i: F.when(i > 0, F.get(r, i - 1)["end"]).otherwise(0)
        each = F.transform(r, lambda v, i: F.concat(part_of(p, stop(i), v["start"] - stop(i)), bullets(part_of(p, v["start"], v["end"] - v["start"]))))
        return F.concat(F.array_join(each, ""), part_of(p, stop(F.size(r)), F.length(text) - stop(F.size(r))))

    return once(F.struct(pieces_of(text).alias("p"), merge_ranges(ranges, F.length(text)).alias("r")), joined)


def ranges_of(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).cast(SPAN)


def cover_ranges(text: Column, hits: Column) -> Column:
    """The whole element, or in an element of more than 2000 characters the hits' ranges only."""
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))).cast(SPAN)
    return F.when(F.size(hits) == 0, F.array().cast(SPAN)).when(F.length(text) > ELEMENT_MOST, ranges_of(hits)).otherwise(all_of_it)


def locked_cover(found: DataFrame, most: int = STICKERS_MOST) -> DataFrame:
    """detect()'s rows with hits: how a locked page covers each, and whether it gets a record (the first ``most`` of a
    document do; the rest is masked without one)."""
    place = F.row_number().over(Window.partitionBy("doc_key").orderBy("block_id"))
    cover = F.when(F.length("text") > ELEMENT_MOST, "range").otherwise("element")
    return found.where(F.size("hits") > 0).select("doc_key", "block_id", cover.alias("cover"), (place <= most).alias("sticker"))


def redact_detected(
    texts: DataFrame, sensitivity: str = "balanced", mode: str = "ranges", detectors: Iterable[Detector] = BUILTIN, as_of_year: int = YEAR
) -> DataFrame:
    """texts with ``redacted`` and ``n_hits``: a projection, without any shuffle.

    mode 'ranges' hides every accepted match; 'element' covers a block by its best hit.
    """
    found = detect(texts, sensitivity, detectors, "all" if mode == "ranges" else "best", as_of_year)
    ranges = ranges_of(F.col("hits")) if mode == "ranges" else cover_ranges(F.col("text"), F.col("hits"))
    hidden = F.when(F.size("hits") > 0, redact_ranges(F.col("text"), ranges)).otherwise(F.col("text"))
    return found.withColumn("redacted", hidden).withColumn("n_hits", F.size("hits")).drop("hits")


def snap_to_tokens(text: Column, ranges: Column) -> Column:
    """Sorted ranges grown to whole tokens; neighbouring hidden tokens take the white space between them.

    Places are looked up among the text's tokens by binary search: two ranges stay apart if a token begins between them.
    """

    def snapped(x: Column) -> Column:
        s, e, r = x["tokens"]["start"], x["tokens"]["end"], x["r"]
        upto = lambda place: count_below_of(s, place)
        # the token that ends in or after a place, if it begins before it
        start = lambda v: once(upto(v), lambda k: F.when((k > 0) & (F.get(e, k - 1) >= v), F.get(s, k - 1)).otherwise(v))
        stop = lambda v: once(upto(v + 1), lambda k: F.when((k > 0) & (F.get(e, k - 1) > v), F.get(e, k - 1)).otherwise(v))
        return merged(F.transform(r, lambda v: start(v["start"])), F.transform(r, lambda v: stop(v["end"])), upto, upto)

    return once(F.struct(match_all(text, f"[^{WS}]+").alias("tokens"), ranges.alias("r")), snapped)


def restore(masked: DataFrame, originals: DataFrame, on: list[str]) -> DataFrame:
    """masked (…, redacted) with ``text`` put back from originals, which only who may see them can read."""
    return masked.join(originals.select(*on, "text"), on)


def mask_mode(tag: Column, attrs: Column) -> Column:
    form = F.upper(tag).isin("INPUT", "TEXTAREA", "SELECT")
    drawn = F.upper(tag).isin("IMG", "SVG", "CANVAS", "VIDEO", "IFRAME", "OBJECT", "EMBED")
    return F.when(form, "input").when(drawn | F.coalesce(F.try_element_at(attrs, F.lit("contenteditable")) == "true", F.lit(False)), "visual-only").otherwise("text")


def scrub_attrs(attrs: Column) -> Column:
    return F.transform_values(attrs, lambda k, v: F.when(k.isin(SHOWN), F.lit("")).otherwise(v))


def scrub_token_attrs(tag: Column, attrs: Column, words: Column, runs: Column) -> Column:
    """Blank what repeats covered text, but for naming, styling and record-key attributes and form values."""
    from ..functions.text import leaks

    form = F.upper(tag).isin("INPUT", "TEXTAREA", "SELECT", "OPTION", "BUTTON")
    return F.transform_values(attrs, lambda k, v: F.when(~k.isin(IDENTITY) & ~((k == "value") & form) & leaks(v, words, runs), F.lit("")).otherwise(v))
