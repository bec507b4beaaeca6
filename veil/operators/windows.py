"""Joins on scopes and spans, nearest positions, newest-N lists and records that change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import WS
from ..functions.identity import PREFIXES, hmac, identity, view_prefix
from ..functions.text import tokens_of
from ..functions.urls import canonical_search, matches_path, normalize_path, search_has_doc_id, split_path
from .matching import once

AUDIT_MOST, DISMISSED_MOST, DETECTORS_MOST, TOKENS_MOST = 200, 500, 50, 32
VIEW_MOST = 1500
#: Rows up to which a side is sent to every task; a larger one is joined by a shuffle.
SEND = 100_000


def small(df: DataFrame, most: int = SEND) -> DataFrame:
    """The table, to be broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def newest(df: DataFrame, keys: list[str], order: list[Column], most: int, place: str | None = None) -> DataFrame:
    """The first ``most`` rows of each key in an order, such as the newest; place: a column for their number in it."""
    name = place or "__place"
    kept = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)
    return kept if place else kept.drop(name)


def nearest(df: DataFrame, keys: list[str], far: Column, pick: str) -> DataFrame:
    """(keys…, pick) of the row of each key that is least far, the lesser of equals: one aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min(F.struct(far.alias("far"), F.col(pick).alias(pick))).alias("x")).select(*keys, f"x.{pick}")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at", removed: str = "removed") -> DataFrame:
    """The latest row of each key of both tables; a change may be a removal. Of equal times a change wins."""
    both = base.withColumn(removed, F.lit(False)).withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__place", place).where(f"__place = 1 and not {removed}").drop("__place", "__new", removed)


def merge_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of each key that overlap or touch, made one."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.where(F.col(end) > F.col(start)).withColumn("__max", F.max(end).over(before))
    marked = marked.withColumn("__island", F.sum(F.when(F.col("__max").isNull() | (F.col(start) > F.col("__max")), 1).otherwise(0)).over(upto))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def scope_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, origin, path_pattern) that apply on pages (page_id, origin, path).

    They meet by origin, number of segments and first segment; a rule that begins with a star by origin and
    number, one with ** by origin and first segment, or by origin if that is a star. The glob is tested then.
    """
    segments = split_path(F.col("path"))
    placed = pages.select("page_id", "origin", "path", F.size(segments).alias("n"), F.get(segments, F.lit(0)).alias("first"))
    parts = split_path(F.col("path_pattern"))
    known = small(rules.select("rule_id", "origin", "path_pattern", F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("first"), F.array_contains(parts, "**").alias("any")))
    starred = F.coalesce(F.col("first").isin("*", "**"), F.lit(False))
    rooted = F.col("first").isNull()
    met = [
        placed.join(known.where(~F.col("any") & ~starred & ~rooted).drop("any"), ["origin", "n", "first"]),
        placed.drop("first").join(known.where(~F.col("any") & (starred | rooted)).drop("any", "first"), ["origin", "n"]),
        placed.drop("n").join(known.where(F.col("any") & ~starred).drop("any", "n"), ["origin", "first"]),
        placed.drop("n", "first").join(known.where(F.col("any") & starred).drop("any", "n", "first"), ["origin"]),
    ]
    joined = reduce(DataFrame.unionByName, [m.select("page_id", "rule_id", "path", "path_pattern") for m in met])
    return joined.where(matches_path(F.col("path_pattern"), F.col("path"))).select("page_id", "rule_id")


def exact_scope_join(pages: DataFrame, rules: DataFrame, key: bytes) -> DataFrame:
    """Rules (rule_id, path_hmac, include_query) of exactly these pages (page_id, path, query)."""
    path = normalize_path(F.col("path"))
    ids = pages.select(
        "page_id",
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("include_query"), identity("path", path, key).alias("path_hmac")),
                F.struct(F.lit(True).alias("include_query"), identity("path", F.concat(path, F.when(search_has_doc_id(F.col("query")), canonical_search(F.col("query"))).otherwise("")), key).alias("path_hmac")),
            )
        ).alias("x"),
    ).select("page_id", "x.*")
    return ids.join(small(rules), ["include_query", "path_hmac"]).select("page_id", "rule_id")


def frame_join(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """(frame_id, rule_id): rules (rule_id, depth, url_hmac) for the address of a frame (frame_id, depth, frame_hmac)."""
    named = small(rules.where("depth > 0 and url_hmac is not null")).select("rule_id", "depth", F.col("url_hmac").alias("frame_hmac"))
    return frames.join(named, ["depth", "frame_hmac"]).select("frame_id", "rule_id")


def frame_rules(rules: DataFrame) -> DataFrame:
    """(depth, rule_ids): the rules that apply in every frame of a depth. A list for each depth, not a pair for each frame."""
    everywhere = rules.where("depth = 0 or url_hmac is null")
    return everywhere.groupBy("depth").agg(F.sort_array(F.collect_list("rule_id")).alias("rule_ids"))


def token_hmacs(texts: DataFrame, keys: list[str], key: bytes) -> DataFrame:
    """(keys…, token, hmac) of every token that could be an identifier: with a digit, or of six characters."""
    words, _ = tokens_of(F.col("text"))
    tokens = texts.select(*keys, F.explode(words).alias("token")).where(F.col("token").rlike("[0-9]") | (F.length("token") >= 6))
    return tokens.withColumn("hmac", identity("token", F.col("token"), key))


def token_backstop(texts: DataFrame, keys: list[str], wanted: DataFrame, key: bytes) -> DataFrame:
    """Tokens of texts whose identity is wanted (hmac): equality before hashing is not possible, so candidates are hashed once."""
    return token_hmacs(texts, keys, key).join(small(wanted.select("hmac").distinct()), "hmac", "left_semi")


def view_match(docs: DataFrame, wanted: DataFrame, key: bytes) -> DataFrame:
    """Documents (doc_id, text) that begin like a stored view (view_id, length, hmac); hashed once for each asked length."""
    lengths = wanted.where(F.col("length") <= VIEW_MOST).select("length").distinct()
    packed = docs.select("doc_id", "text", F.length(F.regexp_replace("text", f"[{WS}]", "")).alias("n"))
    # one row holds the asked lengths, of which there are at most VIEW_MOST
    asked = packed.withColumn("lengths", lengths.agg(F.collect_set("length")).scalar())
    hashed = asked.select("doc_id", "text", F.explode(F.filter("lengths", lambda x: x <= F.col("n"))).alias("length"))
    hashed = hashed.select("doc_id", "length", view_prefix(F.col("text"), F.col("length"), key).alias("hmac"))
    return hashed.join(small(wanted), ["length", "hmac"]).select("doc_id", "view_id")


def locate_exact(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts (keys…, text, needle, near): where the needle stands nearest to ``near``, white space left out, first of equals.

    The text is cut before each occurrence; one pass over the lengths of what is between keeps the best place.
    """
    bare, needle = F.regexp_replace("text", f"[{WS}]", ""), F.regexp_replace("needle", f"[{WS}]", "")
    ready = texts.select(*keys, "near", bare.alias("text_"), needle.alias("needle_")).where((F.length("needle_") > 0) & F.contains("text_", "needle_"))
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(F.col("needle_"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    lengths = F.transform(F.split("text_", literal, -1), F.length)
    first = F.startswith("text_", "needle_")

    def step(acc: Column, n: Column) -> Column:
        far = F.abs(acc["at"] - F.col("near"))
        better = ((acc["at"] > 0) | first) & (acc["far"].isNull() | (far < acc["far"]))
        return F.struct((acc["at"] + n).alias("at"), F.when(better, far).otherwise(acc["far"]).cast("long").alias("far"), F.when(better, acc["at"]).otherwise(acc["best"]).cast("int").alias("best"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("long").alias("far"), F.lit(None).cast("int").alias("best"))
    return ready.select(*keys, F.aggregate(lengths, start, step, lambda acc: acc["best"]).alias("at"))


def locate_by_hash(texts: DataFrame, keys: list[str], wanted: DataFrame, key: bytes) -> DataFrame:
    """Windows of texts (keys…, text) whose identity is wanted (target, length, near, hmac, and keys[0] if wanted
    there only), nearest first, left of equals. Each asked length is hashed once at each place, then met by identity:
    in the text's own row where it brings what is wanted of it, else by a join."""
    own = keys[:1] if keys[0] in wanted.columns else []
    if own:
        listed = wanted.groupBy(*own).agg(F.collect_set("length").alias("lengths"), F.collect_list(F.struct("target", "length", "near", "hmac")).alias("wanted"))
        asked = texts.join(small(listed), own)
    else:  # the asked lengths are one row, and no more of them than a text has characters
        asked = texts.withColumn("lengths", wanted.agg(F.collect_set("length")).scalar())
    fitting = F.filter("lengths", lambda n: n <= F.length("text"))
    windows = asked.withColumn("length", F.explode(fitting)).drop("lengths")
    windows = windows.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("text") - F.col("length"))))
    message = F.concat(F.lit(PREFIXES["cover"]), F.substring(F.col("text"), F.col("at") + 1, F.col("length")))
    if own:
        # no window leaves its row: only those found are shuffled. An outer explode, as a plain one makes the optimizer hash twice
        met = once(hmac(message, key), lambda h: F.filter("wanted", lambda w: (w["length"] == F.col("length")) & (w["hmac"] == h)))
        found = windows.select(*keys, "at", F.explode_outer(met).alias("w")).where("w is not null").select(*keys, "at", "w.target", "w.near")
    else:
        hashed = windows.select(*keys, "length", "at", hmac(message, key).alias("hmac"))
        found = hashed.join(small(wanted), ["length", "hmac"])
    place = F.row_number().over(Window.partitionBy(*keys, "target").orderBy(F.abs(F.col("at") - F.col("near")), "at"))
    return found.withColumn("place", place).where("place = 1").select(*keys, "target", "at")


def _level(w: Column, h: Column) -> Column:
    """The least power of two that is no shorter than either side."""
    return F.greatest(F.ceil(F.log2(F.greatest(w, h))), F.lit(-30)).cast("int")


def _in_cells(boxes: DataFrame, x: str, y: str, w: str, h: str, levels: Column) -> DataFrame:
    """boxes (…, level, and so on) once for each cell that they touch, of their own level and of those above it that occur."""
    at = boxes.withColumn("levels", levels).withColumn("grid", F.explode(F.filter("levels", lambda v: v >= F.col("level")))).drop("levels")
    size = F.pow(F.lit(2.0), F.col("grid"))
    spans = lambda a, n: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(n)) / size))
    return at.withColumn("cx", F.explode(spans(x, w))).withColumn("cy", F.explode(spans(y, h)))


def page_rects(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Rectangles (doc, rect_id, x, y, w, h) cut to the page boxes (doc, page, px, py, pw, ph, width, height) they meet, in points.

    Both sides are dealt to cells of grids: a box of a size lies in at most four cells of the grid of that size. A pair
    meets by equality in the grid of the larger of the two, and counts in the cell where what they share begins. So a document with
    many rectangles and boxes is many keys, and the work follows the pairs that lie close together.
    """
    found = rects.where("w > 0 and h > 0").withColumn("level", _level(F.col("w"), F.col("h")))
    boxes = pages.where("pw > 0 and ph > 0").withColumn("level", _level(F.col("pw"), F.col("ph")))
    # one row: the sizes that occur, powers of two
    levels = found.select("level").unionByName(boxes.select("level")).agg(F.array_sort(F.collect_set("level"))).scalar()
    left = _in_cells(found, "x", "y", "w", "h", levels).withColumnRenamed("level", "level_r")
    right = _in_cells(boxes, "px", "py", "pw", "ph", levels).withColumnRenamed("level", "level_b")
    met = left.join(right, ["doc", "grid", "cx", "cy"]).where(F.col("grid") == F.greatest("level_r", "level_b"))
    x0, y0 = F.greatest("x", "px"), F.greatest("y", "py")
    x1, y1 = F.least(F.col("x") + F.col("w"), F.col("px") + F.col("pw")), F.least(F.col("y") + F.col("h"), F.col("py") + F.col("ph"))
    size = F.pow(F.lit(2.0), F.col("grid"))
    here = (F.floor(x0 / size) == F.col("cx")) & (F.floor(y0 / size) == F.col("cy"))
    sx, sy = F.col("width") / F.col("pw"), F.col("height") / F.col("ph")
    return met.where(here & (x1 > x0) & (y1 > y0)).select(
        "doc", "rect_id", "page", ((x0 - F.col("px")) * sx).alias("x"), ((y0 - F.col("py")) * sy).alias("y"), ((x1 - x0) * sx).alias("w"), ((y1 - y0) * sy).alias("h")
    )


def reconcile(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(…, state): rows that are present but not wanted (stale) and wanted but not present (missing)."""
    stale, missing = present.exceptAll(wanted).distinct(), wanted.exceptAll(present).distinct()
    return stale.withColumn("state", F.lit("stale")).unionByName(missing.withColumn("state", F.lit("missing")))
