"""Queries over the markup of all pages: elements, blocks, scanning, linking and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import input_kinds, tokens_of
from ..operators import detectors as D
from ..operators import edits as E
from ..operators import link as L
from ..operators import page_scan as P
from ..operators import redact as R
from ..sources import html
from ..sources.readers import table
from ..sources.store import written
from .registry import query
from .texts import KEY

_ALL = (*D.BUILTIN, *[d for d in D.CATALOG if d.id in ("email", "phone-us")])


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


@query("b01_html_elements")
def b01_html_elements(spark, sf_dir):
    return html.html_elements(_pages(spark, sf_dir)).select("page_id", "node_id", "parent_id", "tag", "nth", "nth_of_type", "is_inline", "label_source")


@query("b02_block_text")
def b02_block_text(spark, sf_dir):
    return html.block_text(_pages(spark, sf_dir)).select("page_id", "block_id", "node_id", "text", F.size("segs").alias("segments"))


@query("b03_ranges_for")
def b03_ranges_for(spark, sf_dir):
    """Every block as ranges of its text nodes."""
    blocks = html.block_text(_pages(spark, sf_dir))
    return blocks.select("page_id", "block_id", F.explode(P.ranges_for(F.col("segs"), F.lit(0), F.length("text"))).alias("r")).select("page_id", "block_id", "r.*")


@query("b04_target_for")
def b04_target_for(spark, sf_dir):
    blocks = html.block_text(_pages(spark, sf_dir))
    return blocks.select("page_id", "block_id", P.target_for(F.col("segs"), F.lit(0), F.length("text"), F.col("node_id")).alias("node_id"))


@query("b07_identity_path")
def b07_identity_path(spark, sf_dir):
    return P.identity_path(html.html_elements(_pages(spark, sf_dir)))


@query("b08_css_path")
def b08_css_path(spark, sf_dir):
    return P.css_path(html.html_elements(_pages(spark, sf_dir)))


@query("b09_labels")
def b09_labels(spark, sf_dir):
    return html.html_elements(_pages(spark, sf_dir)).where("label is not null").select("page_id", "node_id", "label", "label_source")


@query("b10_table_context")
def b10_table_context(spark, sf_dir):
    return P.table_context(html.html_elements(_pages(spark, sf_dir)))


@query("b11_elements_near_label")
def b11_elements_near_label(spark, sf_dir):
    return P.elements_near_label(html.html_elements(_pages(spark, sf_dir)))


@query("b12_form_fields")
def b12_form_fields(spark, sf_dir):
    fields = P.form_fields(html.html_elements(_pages(spark, sf_dir)))
    return fields.select("page_id", "node_id", "value", F.array_join(input_kinds(F.col("attrs")), " ").alias("kinds"))


@query("b13_key_attr")
def b13_key_attr(spark, sf_dir):
    return P.key_attr(html.html_elements(_pages(spark, sf_dir)))


@query("d15_scan_pages")
def d15_scan_pages(spark, sf_dir):
    return P.scan(_pages(spark, sf_dir), detectors=_ALL).drop("label")


@query("r08_scrub_attrs")
def r08_scrub_attrs(spark, sf_dir):
    """Attributes of every element after what shows text and what repeats the element's own text is blanked."""
    words, runs = tokens_of(F.col("text_content"))
    found = html.html_elements(_pages(spark, sf_dir)).where(F.size("attrs") > 0)
    scrubbed = found.withColumn("attrs", R.scrub_token_attrs(F.col("tag"), R.scrub_attrs(F.col("attrs")), words, runs))
    return scrubbed.select("page_id", "node_id", R.mask_mode(F.col("tag"), F.col("attrs")).alias("mode"), F.explode("attrs").alias("name", "value"))


def _linked(spark, sf_dir):
    prints = written(L.fingerprint(written(html.html_elements(_pages(spark, sf_dir))), KEY))
    # every element is a stored record, also one known by id, key or path only; linking finds it again
    stickers = prints.withColumn("sticker_id", F.concat_ws(":", "page_id", "node_id"))
    pairs = L.candidates(stickers, prints)
    return prints, stickers, L.score(pairs, stickers, prints)


@query("l03_resolve")
def l03_resolve(spark, sf_dir):
    return L.resolve(_linked(spark, sf_dir)[2])


@query("l04_masked_ties")
def l04_masked_ties(spark, sf_dir):
    return L.masked_ties(_linked(spark, sf_dir)[2])


@query("j08_text_backstop")
def j08_text_backstop(spark, sf_dir):
    prints, stickers, _ = _linked(spark, sf_dir)
    return L.text_backstop(stickers, prints)


@query("j15_drift")
def j15_drift(spark, sf_dir):
    prints, stickers, scored = _linked(spark, sf_dir)
    return L.drift(L.resolve(scored), stickers, prints)


_EDITED = "regexp_replace(regexp_replace(text, '(^|[^0-9A-Za-z_À-ɏ])All[\\s]+rights([^0-9A-Za-z_À-ɏ]|$)', '\\1No rights\\2', 'g'), '$^', '')"


@query("r11_apply_edits", f"SELECT doc_id, {_EDITED} AS edited, len(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_À-ɏ])All[\\s]+rights(?:[^0-9A-Za-z_À-ɏ]|$)'))::INT AS copies FROM documents")
def r11_apply_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return E.apply_edits(docs, [("All rights", "No rights", True)]).select("doc_id", "edited", "copies")


@query("r12_mirror_attrs")
def r12_mirror_attrs(spark, sf_dir):
    found = html.html_elements(_pages(spark, sf_dir)).where(F.size("attrs") > 0)
    return found.select("page_id", "node_id", F.explode(E.mirror_attrs(F.col("attrs"), "example", "sample")).alias("name", "value"))


