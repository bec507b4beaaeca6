"""The markup reader, and what of a page's structure needs no other row."""

import pytest
from pyspark.sql import functions as F

from veil.functions.identity import hmac
from veil.operators import link, page_scan, rules, windows
from veil.plans import markup
from veil.plans.library import QUERIES
from veil.sources import html

SF = "/root/testdata/sf0.001"
PLAIN = [
    '<html><body><h2>Order 1</h2><form><label for="f">SSN</label><input id="f" value="1" disabled><textarea name="n">note</textarea></form></body></html>',
    "<p>a<p>b &amp; c &lt;d&gt;<ul><li>x<li>y</ul><br/><div/>tail <b>e</b>",
    '<table data-key="K"><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></table>',
]
ODD = ["<p>a < b</p>", "<script>if (a<b) '</p>'</script><p>x</p>", '<a title="x > y">z</a>', "<p id=f>q</p>", "<textarea><b>x</b></textarea>", "<textarea>a &amp; b</textarea>", "<!-- c --><p>x &", "<title>t"]


@pytest.mark.parametrize("markup_of", PLAIN)
def test_plain_markup_is_read_without_the_tokenizer(markup_of):
    read = html.Events(markup_of)
    assert html._plain_events(markup_of) == (read.codes, read.attrs, read.texts)


@pytest.mark.parametrize("markup_of", ODD)
def test_other_markup_is_left_to_the_tokenizer(markup_of):
    assert html._plain_events(markup_of) is None


def test_pages_of_one_shape_share_it():
    one, other = html.Page(markup_of(1)), html.Page(markup_of(22))
    assert one.shape is other.shape and (one.text(5), other.text(5)) == ("r1", "r22")
    assert len({html.Page(f"<p>{'<b>x</b>' * k}</p>").shape for k in range(9)}) == 9


def markup_of(k):
    return f'<table data-key="K"><tr><td>x</td></tr><tr><td>{k}</td></tr></table>'.replace(f"<td>{k}", f"<td>r{k}")


def test_deep_pages_are_read(spark):
    deep = "<div>" * 3000 + "x"
    assert html.block_text(spark.createDataFrame([(1, deep)], "page_id long, html string")).first().text == "x"


@pytest.mark.parametrize("name", ["b07_identity_path", "b08_css_path", "b08_xpath", "b08_paths_below_an_id", "b10_table_context", "b13_key_attr", "l01_names"])
def test_structure_needs_no_join(spark, name):
    plan = QUERIES[name if name in QUERIES and name.endswith("id") else f"{name}_of_orders"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("MapInArrow") == 1


def test_only_wanted_columns_are_made(spark):
    pages = spark.createDataFrame([(1, PLAIN[0])], "page_id long, html string")
    assert html.html_elements(pages, "page_id", "tag").columns == ["page_id", "tag"]
    plan = QUERIES["b11_near_label_of_orders"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "text_content" not in plan and "attrs" not in plan


@pytest.mark.parametrize("most", [2, 8, 30])
def test_css_paths_of_any_length(spark, most):
    deep = "<div>" * 9 + "<p>a</p><p>b</p>"
    found = page_scan.css_path(html.html_elements(spark.createDataFrame([(1, deep)], "page_id long, html string")), most)
    rows = {r.node_id: r for r in found.collect()}
    assert rows[11].css_path == ">".join((["div"] * 9 + ["p:nth-of-type(2)"])[-most:]) and rows[11].unique
    assert rows[9].unique == (most == 30)


@pytest.mark.parametrize("most", [1000, 3])
def test_pages_are_linked_in_one_pass(spark, monkeypatch, most):
    """As by candidates and their scores, also where pages count as large; one sticker is found by its text alone."""
    monkeypatch.setattr(link, "PAGE_MOST", most)
    before, after = markup._snapshots(spark, SF)
    few = F.col("page_id") < 12
    before = before.where(few)
    alone = before.where("page_id = 3 and node_id = 15").withColumn("sticker_id", F.lit("alone")).withColumn("label", F.lit("other"))
    for c in ("css_path", "xpath", "key_hmac", "column_label", "id_ref"):
        alone = alone.withColumn(c, F.lit(None).cast("string"))
    before, after = before.unionByName(alone).cache(), after.where(few).cache()
    got, want = link.scored(before, after), link.score(link.candidates(before, after), before, after)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and any(r[0] == "alone" for r in rows)


def test_fingerprints_need_only_the_columns_of_what_is_wanted(spark):
    elements = html.html_elements(spark.createDataFrame([(1, PLAIN[0])], "page_id long, html string"), "page_id", "node_id", "attrs")
    rows = link.fingerprint(elements, b"k" * 32, "node_id", "id_ref").collect()
    assert [(r.node_id, r.id_ref) for r in rows if r.id_ref] == [(6, "f")]


def test_fields_alone_are_read(spark):
    pages = spark.createDataFrame([(1, "<p>call 555 123 4567</p><input value='123-45-6789'>")], "page_id long, html string")
    assert [r.text for r in html.scanned(pages, blocks=False).collect()] == ["123-45-6789"]
    assert [r.text for r in html.scanned(pages, fields=False).collect()] == ["call 555 123 4567"]


def test_detectors_of_sites_are_not_made_distinct_after_the_join(spark):
    pages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None)], "page_id long, origin string")
    custom = spark.createDataFrame([("g", "global", None), ("s", "site", "a"), ("s", "site", "b"), ("g", "site", "a"), ("t", "site", "b")], "id string, scope string, origin string")
    toggles = spark.createDataFrame([("a", "email", True), ("b", "email", True), ("b", "vin", False)], "origin string, entry string, on boolean")
    found = rules.detectors_for_site(pages, custom, toggles)
    assert sorted(map(tuple, found.collect())) == [(1, "catalog:email"), (1, "g"), (1, "s"), (1, "t"), (2, "catalog:email"), (2, "g"), (2, "s"), (3, "g")]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_windows_are_found_in_their_row(spark):
    """Two targets of one text, the nearest place of each; no window is sent to a join."""
    key = b"k" * 32
    texts = spark.createDataFrame([("a", "xabcabcab"), ("b", "abc"), ("c", "none")], "doc string, text string")
    asked = spark.createDataFrame([("a", "one", 3, 5, "abc"), ("a", "two", 2, 9, "ab"), ("b", "none", 9, 0, "abc"), ("b", "one", 3, 7, "abc"), ("c", "one", 3, 0, "abc")], "doc string, target string, length int, near int, said string")
    wanted = asked.select("doc", "target", "length", "near", hmac(F.concat(F.lit("cover\0"), "said"), key).alias("hmac"))
    found = windows.locate_by_hash(texts, ["doc"], wanted, key)
    assert sorted(map(tuple, found.select("doc", "target", "at").collect())) == [("a", "one", 4), ("a", "two", 7), ("b", "one", 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
