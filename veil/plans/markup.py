"""Queries over pages made from all orders: forms, tables, links and labels whose rows SQL can state.

Each order is one page of 19 nodes, so what an operator gives is known by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import input_kinds, tokens_of
from ..operators import edits as E
from ..operators import link as L
from ..operators import page_scan as P
from ..operators import redact as R
from ..sources import html
from ..sources.readers import spread, table
from ..sources.store import written
from .registry import query
from .texts import KEY

#: A number of the shape and range of a valid one, from the order's key.
SSN = "concat(cast(100 + o_orderkey % 500 as string), '-', cast(10 + o_orderkey % 89 as string), '-', cast(1000 + o_orderkey % 8999 as string))"
#: Node numbers: html 1, body 2, h2 3, form 4, label 5, input 6, textarea 7, hidden input 8, table 9, tr 10, th 11 12, tr 13, td 14 15, p 16, b 17, a 18.
PAGE = f"""concat(
  '<html><body><h2>Order ', o_orderkey, '</h2><form><label for="f">SSN</label><input id="f" name="ssn" value="', {SSN}, '" title="typed ', o_orderkey, '">',
  '<textarea name="note">note ', o_orderkey, '</textarea><input type="hidden" value="x"></form>',
  '<table data-key="K', o_custkey, '"><tr><th>Priority</th><th>Social security</th></tr><tr data-id="r', o_orderkey, '"><td>', o_orderpriority, '</td><td>', {SSN}, '</td></tr></table>',
  '<p>Total of order <b>', o_orderkey, '</b> is due</p><a href="/o/', o_orderkey, '">see ', o_orderkey, '</a></body></html>')"""


def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return spread(made).select(F.col("o_orderkey").alias("page_id"), F.expr(PAGE).alias("html"))


# -- the same in SQL: what each of a page's nodes gives, with the order's values put in --

_SSN = "concat(100 + o_orderkey % 500, '-', 10 + o_orderkey % 89, '-', 1000 + o_orderkey % 8999)"


def _rows(columns: str, rows: list[tuple], where: str = "true") -> str:
    """SQL of these rows for every order; @k, @c, @p and @s stand for its key, customer, priority and number."""
    kinds = dict(c.split() for c in columns.split(", "))
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    listed = ", ".join(f"({', '.join(map(value, row))})" for row in rows)
    filled = "replace(replace(replace(replace({0}, '@k', o_orderkey::VARCHAR), '@c', o_custkey::VARCHAR), '@p', o_orderpriority), '@s', " + _SSN + ")"
    shown = ", ".join(f"{filled.format(chr(34) + c + chr(34)) if t == 'VARCHAR' else f'{chr(34)}{c}{chr(34)}::{t}'} AS \"{c}\"" for c, t in kinds.items())
    return f"SELECT o_orderkey AS page_id, {shown} FROM orders CROSS JOIN (VALUES {listed}) v({', '.join(chr(34) + c + chr(34) for c in kinds)}) WHERE {where}"


_HEAD = "PrioritySocial security"
#: node: (parent, tag, place, place of its tag, inline, path, css path, label, where the label stands)
_NODES = {
    1: (0, "HTML", 1, 1, False, "html:1", "html", None, None),
    2: (1, "BODY", 1, 1, False, "html:1/body:1", "html>body", None, None),
    3: (2, "H2", 1, 1, False, "html:1/body:1/h2:1", "html>body>h2", None, None),
    4: (2, "FORM", 2, 1, False, "html:1/body:1/form:1", "html>body>form", "Order @k", "sibling"),
    5: (4, "LABEL", 1, 1, True, "html:1/body:1/form:1/label:1", "html>body>form>label", None, None),
    6: (4, "INPUT", 2, 1, True, "html:1/body:1/form:1/input:1", "html>body>form>input:nth-of-type(1)", "SSN", "label"),
    7: (4, "TEXTAREA", 3, 1, False, "html:1/body:1/form:1/textarea:1", "html>body>form>textarea", "SSN", "text"),
    8: (4, "INPUT", 4, 2, True, "html:1/body:1/form:1/input:2", "html>body>form>input:nth-of-type(2)", "SSNnote @k", "text"),
    9: (2, "TABLE", 3, 1, False, "html:1/body:1/table:1", "html>body>table", "SSNnote @k", "sibling"),
    10: (9, "TR", 1, 1, False, "html:1/body:1/table:1/tr:1", "html>body>table>tr:nth-of-type(1)", "SSNnote @k", "outer"),
    11: (10, "TH", 1, 1, False, "html:1/body:1/table:1/tr:1/th:1", "html>body>table>tr:nth-of-type(1)>th:nth-of-type(1)", None, None),
    12: (10, "TH", 2, 2, False, "html:1/body:1/table:1/tr:1/th:2", "html>body>table>tr:nth-of-type(1)>th:nth-of-type(2)", "Priority", "sibling"),
    13: (9, "TR", 2, 2, False, "html:1/body:1/table:1/tr:2", "html>body>table>tr:nth-of-type(2)", _HEAD, "sibling"),
    14: (13, "TD", 1, 1, False, "html:1/body:1/table:1/tr:2/td:1", "html>body>table>tr:nth-of-type(2)>td:nth-of-type(1)", "Priority", "column"),
    15: (13, "TD", 2, 2, False, "html:1/body:1/table:1/tr:2/td:2", "html>body>table>tr:nth-of-type(2)>td:nth-of-type(2)", "Social security", "column"),
    16: (2, "P", 4, 1, False, "html:1/body:1/p:1", "html>body>p", "#before#", "text"),
    17: (16, "B", 1, 1, True, "html:1/body:1/p:1/b:1", "html>body>p>b", "Total of order", "text"),
    18: (2, "A", 5, 1, True, "html:1/body:1/a:1", "html>body>a", "Total of order @k is due", "sibling"),
}
#: block: (node, text, pieces as (node, start, end); None is the end of the text)
_BLOCKS = [
    (3, "Order @k"), (4, "SSN"), (11, "Priority"), (12, "Social security"), (14, "@p"), (15, "@s"), (16, "Total of order @k is due"), (2, "see @k"),
]
#: of the text before a paragraph 40 characters count
_CUT = f"replace(label, '#before#', trim(right('SSNnote ' || o_orderkey || '{_HEAD}' || o_orderpriority || {_SSN}, 40)))"


def _labels(columns: str, rows: list[tuple], shown: str) -> str:
    inner = _rows(columns, rows).replace("FROM orders", ", o_orderpriority, o_orderkey FROM orders", 1)
    return f"SELECT page_id, {shown.replace('label', _CUT + ' AS label', 1)} FROM ({inner})"


def _elements(spark, sf_dir, columns):
    """The elements of made pages, with these columns."""
    return html.html_elements(made_pages(spark, sf_dir), "page_id", "node_id", *columns.split())


@query(
    "b01_elements_of_orders",
    _rows("node_id INT, parent_id INT, tag VARCHAR, nth INT, nth_of_type INT, is_inline BOOLEAN, label_source VARCHAR", [(n, *x[:5], x[8]) for n, x in _NODES.items()]),
)
def b01_elements_of_orders(spark, sf_dir):
    return _elements(spark, sf_dir, "parent_id tag nth nth_of_type is_inline label_source")


@query("b02_blocks_of_orders", _rows("block_id INT, node_id INT, text VARCHAR, segments INT", [(i, n, t, 3 if n == 16 else 1) for i, (n, t) in enumerate(_BLOCKS)]))
def b02_blocks_of_orders(spark, sf_dir):
    return html.block_text(made_pages(spark, sf_dir)).select("page_id", "block_id", "node_id", "text", F.size("segs").alias("segments"))


_TOUCHED = [(0, 3, 0, "Order @k"), (1, 5, 0, "SSN"), (2, 11, 0, "Priority"), (3, 12, 0, "Social security"), (4, 14, 0, "@p"), (5, 15, 0, "@s"), (6, 16, 0, "Total of order "), (6, 17, 0, "@k"), (6, 16, 0, " is due"), (7, 18, 0, "see @k")]


@query("b03_ranges_of_orders", f"SELECT page_id, block_id, node_id, start, length(piece)::INT AS \"end\" FROM ({_rows('block_id INT, node_id INT, start INT, piece VARCHAR', _TOUCHED)})")
def b03_ranges_of_orders(spark, sf_dir):
    """The text nodes of whole blocks."""
    blocks = html.block_text(made_pages(spark, sf_dir))
    return blocks.select("page_id", "block_id", F.explode(P.ranges_for(F.col("segs"), F.lit(0), F.length("text"))).alias("r")).select("page_id", "block_id", "r.*")


@query("b04_targets_of_orders", _rows("block_id INT, node_id INT", [(i, {4: 5, 2: 18}.get(n, n)) for i, (n, _) in enumerate(_BLOCKS)]))
def b04_targets_of_orders(spark, sf_dir):
    """The deepest element over each whole block."""
    blocks = html.block_text(made_pages(spark, sf_dir))
    return blocks.select("page_id", "block_id", P.target_for(F.col("segs"), F.lit(0), F.length("text"), F.col("node_id")).alias("node_id"))


@query("b07_identity_path_of_orders", _rows("node_id INT, identity_path VARCHAR", [(n, x[5]) for n, x in _NODES.items()]))
def b07_identity_path_of_orders(spark, sf_dir):
    return P.identity_path(_elements(spark, sf_dir, "steps above"))


@query("b08_css_path_of_orders", _rows("node_id INT, css_path VARCHAR, unique BOOLEAN", [(n, x[6], True) for n, x in _NODES.items()]))
def b08_css_path_of_orders(spark, sf_dir):
    return P.css_path(_elements(spark, sf_dir, "steps alike"))


_XPATHS = [(n, "/" + "/".join(f"{t}[{i}]" for t, i in (step.split(":") for step in x[5].split("/")))) for n, x in _NODES.items()]


@query("b08_xpath_of_orders", _rows("node_id INT, xpath VARCHAR", _XPATHS))
def b08_xpath_of_orders(spark, sf_dir):
    return P.xpath(_elements(spark, sf_dir, "steps"))


# below a form with an id an identity path begins there, a positional one does not
_FROM_FORM = [(n, x[5].replace("html:1/body:1/form:1", "#entry"), dict(_XPATHS)[n]) for n, x in _NODES.items()]


@query("b08_paths_below_an_id", _rows("node_id INT, identity_path VARCHAR, xpath VARCHAR", _FROM_FORM))
def b08_paths_below_an_id(spark, sf_dir):
    pages = made_pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<form>"), F.lit('<form id="entry">')))
    elements = html.html_elements(pages, "page_id", "node_id", "steps", "above")
    return elements.select("page_id", "node_id", P.identity_path_of(F.col("steps"), F.col("above")).alias("identity_path"), P.xpath_of(F.col("steps")).alias("xpath"))


_REFS = "CASE n WHEN 6 THEN 'ssn' WHEN 7 THEN 'note' END"


@query("l01_names_of_orders", f"SELECT o_orderkey AS page_id, n::INT AS node_id, CASE WHEN n = 6 THEN 'f' END AS id_ref, {_REFS} AS name_ref FROM orders CROSS JOIN (SELECT unnest(range(1, 19)) AS n)")
def l01_names_of_orders(spark, sf_dir):
    """Ids and names that a developer gave are stored as they are."""
    return L.fingerprint(_elements(spark, sf_dir, "attrs"), KEY, "page_id", "node_id", "id_ref", "name_ref")


_LABELLED = [(n, x[7], x[8]) for n, x in _NODES.items() if x[7]]


@query("b09_labels_of_orders", _labels("node_id INT, label VARCHAR, label_source VARCHAR", _LABELLED, "node_id, label, label_source"))
def b09_labels_of_orders(spark, sf_dir):
    return _elements(spark, sf_dir, "label label_source").where("label is not null").select("page_id", "node_id", "label", "label_source")


_CELLS = [(11, 1, 1, "Priority"), (12, 1, 2, "Social security"), (14, 2, 1, "Priority"), (15, 2, 2, "Social security")]


@query("b10_table_context_of_orders", _rows("node_id INT, row_index INT, col_index INT, column_label VARCHAR", _CELLS))
def b10_table_context_of_orders(spark, sf_dir):
    return P.table_context(_elements(spark, sf_dir, "row_index col_index column_label"))


@query("b11_near_label_of_orders", f"SELECT page_id, node_id, tag, lower(label) AS label FROM ({_labels('node_id INT, tag VARCHAR, label VARCHAR', [(n, x[1], x[7]) for n, x in _NODES.items() if x[7]], 'node_id, tag, label')})")
def b11_near_label_of_orders(spark, sf_dir):
    return P.elements_near_label(_elements(spark, sf_dir, "tag label"))


@query("b12_fields_of_orders", _rows("node_id INT, value VARCHAR, kinds VARCHAR", [(6, "@s", "ssn"), (7, "note @k", "")]))
def b12_fields_of_orders(spark, sf_dir):
    fields = P.form_fields(_elements(spark, sf_dir, "tag attrs text_content label"))
    return fields.select("page_id", "node_id", "value", F.array_join(input_kinds(F.col("attrs")), " ").alias("kinds"))


@query("b13_key_attr_of_orders", _rows("node_id INT, record_key VARCHAR", [(n, "K@c") for n in (9, 10, 11, 12)] + [(n, "r@k") for n in (13, 14, 15)]))
def b13_key_attr_of_orders(spark, sf_dir):
    return P.key_attr(_elements(spark, sf_dir, "above"))


_HIT = "node_id INT, pattern VARCHAR, strength VARCHAR, bonus INT, score INT, wide BOOLEAN, is_input BOOLEAN, block_id INT, value VARCHAR, label VARCHAR"
_FIELD, _CELL = (6, "ssn", "high", 3, 6, False, True, -1, "@s", "SSN"), (15, "ssn", "high", 2, 5, False, False, 5, "@s", "Social security")
_SHOWN = "page_id, node_id, pattern, strength, bonus, score, wide, is_input, block_id, 0 AS start, length(value)::INT AS \"end\", label"


@query("d14_fields_of_orders", f"SELECT {_SHOWN} FROM ({_rows(_HIT, [_FIELD])})")
def d14_fields_of_orders(spark, sf_dir):
    return P.input_hits(made_pages(spark, sf_dir)).drop("name")


@query("d15_scan_of_orders", f"SELECT {_SHOWN} FROM ({_rows(_HIT, [_FIELD, _CELL])})")
def d15_scan_of_orders(spark, sf_dir):
    return P.scan(made_pages(spark, sf_dir)).drop("name")


_ATTRS = [
    (5, "text", "for", "f"), (6, "input", "id", "f"), (6, "input", "name", "ssn"), (6, "input", "value", "@s"), (6, "input", "title", "typed @k"), (7, "input", "name", "note"),
    (8, "input", "type", "hidden"), (8, "input", "value", "x"), (9, "text", "data-key", "K@c"), (13, "text", "data-id", "r@k"), (18, "text", "href", "/o/@k"),
]


@query("r08_scrub_of_orders", _rows("node_id INT, mode VARCHAR, name VARCHAR, value VARCHAR", [(*x[:3], "" if x[2] == "title" else x[3]) for x in _ATTRS]))
def r08_scrub_of_orders(spark, sf_dir):
    words, runs = tokens_of(F.col("text_content"))
    found = _elements(spark, sf_dir, "tag attrs text_content").where(F.size("attrs") > 0)
    scrubbed = found.withColumn("attrs", R.scrub_token_attrs(F.col("tag"), R.scrub_attrs(F.col("attrs")), words, runs))
    return scrubbed.select("page_id", "node_id", R.mask_mode(F.col("tag"), F.col("attrs")).alias("mode"), F.explode("attrs").alias("name", "value"))


@query("r12_mirror_of_orders", _rows("node_id INT, name VARCHAR, value VARCHAR", [(x[0], x[2], x[3].replace("typed", "sample")) for x in _ATTRS]))
def r12_mirror_of_orders(spark, sf_dir):
    found = _elements(spark, sf_dir, "attrs").where(F.size("attrs") > 0)
    return found.select("page_id", "node_id", F.explode(E.mirror_attrs(F.col("attrs"), "typed", "sample")).alias("name", "value"))


# -- linking: every element of a page is stored, and is found again in a later snapshot of it --


def later_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of odd keys got a notice on top, so nodes stand one further; in those of keys by five the number is another."""
    pages = made_pages(spark, sf_dir)
    moved = F.when(F.col("page_id") % 2 == 1, F.replace("html", F.lit("<h2>"), F.lit("<div>Notice</div><h2>"))).otherwise(F.col("html"))
    cell = F.regexp_replace(moved, "<td>[0-9]{3}-[0-9]{2}-[0-9]{4}</td>", "<td>none</td>")
    return pages.select("page_id", F.when(F.col("page_id") % 5 == 0, cell).otherwise(moved).alias("html"))


def _snapshots(spark, sf_dir, of=L.OF_ELEMENTS, *columns):
    """Every element as it is stored, and of the later snapshot; columns: only these of their fingerprints, which are made of those of elements."""
    prints = lambda pages: written(L.fingerprint(html.html_elements(pages, *of), KEY, *columns))
    return prints(made_pages(spark, sf_dir)).withColumn("sticker_id", F.concat_ws(":", "page_id", "node_id")), prints(later_pages(spark, sf_dir))


def _scored(spark, sf_dir):
    return L.scored(*_snapshots(spark, sf_dir))


_STORED = "SELECT o_orderkey AS page_id, n, concat(o_orderkey, ':', n) AS sticker_id, (n + CASE WHEN o_orderkey % 2 = 1 AND n > 2 THEN 1 ELSE 0 END)::INT AS node_id FROM orders CROSS JOIN (SELECT unnest(range(1, 19)) AS n)"


# a changed text takes html and body below the threshold: nothing but path and selector (40, less 40 %) is left of them
@query("l03_resolve_orders", f"SELECT sticker_id, page_id, node_id FROM ({_STORED}) WHERE NOT (n <= 2 AND (page_id % 2 = 1 OR page_id % 5 = 0))")
def l03_resolve_orders(spark, sf_dir):
    return L.resolve(_scored(spark, sf_dir)).select("sticker_id", "page_id", "node_id")


@query("j15_drift_of_orders", f"SELECT sticker_id, page_id, node_id FROM ({_STORED}) WHERE page_id % 5 = 0 AND n IN (9, 13, 15)")
def j15_drift_of_orders(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return L.drift(L.resolve(L.scored(before, after)), before, after)


@query("j08_backstop_of_orders", f"SELECT sticker_id, page_id, node_id FROM ({_STORED}) WHERE n IN (14, 15) AND NOT (page_id % 5 = 0 AND n = 15)")
def j08_backstop_of_orders(spark, sf_dir):
    """The table's cells as lost stickers, found by their text; a changed one is not."""
    before, after = _snapshots(spark, sf_dir, ("page_id", "node_id", "path", "text_content"), "page_id", "node_id", "path", "text_len", "text_hmac")
    return L.text_backstop(before.where("node_id in (14, 15)"), after)


@query("j10_pattern_backstop_of_orders", "SELECT concat(o_orderkey, ':15') AS sticker_id, o_orderkey AS page_id, (6 + o_orderkey % 2)::INT AS node_id FROM orders")
def j10_pattern_backstop_of_orders(spark, sf_dir):
    """The number's cell as a lost sticker: of its detector's hits the field under its heading, not the one in its own column."""
    before, after = _snapshots(spark, sf_dir, ("page_id", "node_id", "label", "label_source", "heading", "column_label"), "page_id", "node_id", "label", "heading", "column_label")
    lost = before.where("node_id = 15").select("sticker_id", "page_id", F.lit("ssn").alias("pattern"), "label", "heading", "column_label")
    return L.pattern_backstop(lost, P.scan(later_pages(spark, sf_dir)), after)


@query("l04_masked_ties_of_orders", f"SELECT sticker_id, page_id, node_id FROM ({_STORED}) WHERE NOT (n <= 2 AND (page_id % 2 = 1 OR page_id % 5 = 0))")
def l04_masked_ties_of_orders(spark, sf_dir):
    """While locked: what stands out is masked alone, as no element of these pages is like another."""
    return L.masked_ties(_scored(spark, sf_dir))
