"""Site rules, agreement with a truth, and writers."""

import pytest
from pyspark.sql import functions as F

from veil.operators import rules
from veil.operators.redact import redact_detected
from veil.sources import readers, sinks


def test_detectors_for_site(spark):
    pages = spark.createDataFrame([(1, "https://a"), (2, "https://b")], "page_id long, origin string")
    custom = spark.createDataFrame([("g", "global", None), ("s", "site", "https://a"), ("n", "site", None)], "id string, scope string, origin string")
    toggles = spark.createDataFrame([("https://b", "email", True), ("https://a", "vin", False)], "origin string, entry string, on boolean")
    found = sorted(map(tuple, rules.detectors_for_site(pages, custom, toggles).collect()))
    assert found == [(1, "g"), (1, "n"), (1, "s"), (2, "catalog:email"), (2, "g"), (2, "n")]


def test_precision_recall(spark):
    schema = "doc_key string, block_id int, start int, end int"
    hits = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 10, 30), ("b", 0, 0, 3)], schema)
    truth = spark.createDataFrame([("a", 0, 0, 8), ("a", 0, 12, 20), ("c", 0, 0, 3)], schema)
    row = rules.precision_recall(hits, truth).first()
    assert (round(row.precision, 3), round(row.recall, 3), row.hits, row.positives) == (0.667, 0.667, 3, 3)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "label"), ("b", "SSN 123-45-6789")], "id string, label string")
    dropped = sinks.guarded_write(rows, "id", str(tmp_path / "records"))
    assert [r.id for r in dropped.collect()] == ["b"] and spark.read.parquet(str(tmp_path / "records")).count() == 1
    with pytest.raises(ValueError):
        sinks.assert_clean(rows, "id")
    texts = spark.createDataFrame([("d", 0, "SSN 123-45-6789")], "doc_key string, block_id int, text string")
    sinks.write_redacted(redact_detected(texts), str(tmp_path / "redacted"))
    back = spark.read.parquet(str(tmp_path / "redacted"))
    assert back.columns == ["doc_key", "block_id", "redacted", "n_hits"] and back.first().redacted == "SSN •••••••••••"
    ids = spark.createDataFrame([("o", f"{i:064x}", i) for i in range(3)] + [("o", "raw", 9)], "origin string, id string, place int")
    assert sorted(r.place for r in sinks.clean_dismissed(ids, 2).collect()) == [1, 2]


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"v": 1, "origin": "https://a", "stickers": []}\n{"v": 2, "origin": "https://b"}\n')
    found = readers.read_records(spark, str(tmp_path / "r.json"))
    assert [r.origin for r in found.collect()] == ["https://a"] and found.select(F.size("stickers")).first()[0] == 0


def test_fixed_letters_and_open_counts(spark):
    """A format's own letters are quoted and bounded as words; a unit without an upper count is open."""
    from veil.operators import teach

    rows = [
        ([("sep", "M", 1, 1), ("sep", "B", 1, 1), ("sep", "-", 1, 1), ("digit", None, 4, None)], r"\bMB-\d{4,}\b", '"MB", 4 or more digits'),
        ([("upper", None, 1, None), ("sep", ".", 2, 2), ("sep", "7", 2, 2)], r"\b[A-Z]+(?:\.){2}7{2}\b", '1 or more letters, "77"'),
        ([("any", None, 0, None), ("alnum", None, 2, 3)], r".*[A-Za-z0-9]{2,3}\b", "any number of characters, 2–3 letters or digits"),
        ([("sep", "-", 1, 1)], "-", "separators only"),
    ]
    made = spark.createDataFrame([(u, r, d) for u, r, d in rows], f"units {teach.UNITS}, regex string, said string")
    for r in made.select("regex", "said", teach.units_to_regex(made.units).alias("a"), teach.describe_units(made.units).alias("b")).collect():
        assert (r.a, r.b) == (r.regex, r.said)


def test_toggles_keep_good_keys_with_values(spark):
    rows = spark.createDataFrame([({"email": True, "vin": False, "none": None, "Bad Key": True, "": True, "x" * 41: True, "x" * 40: False},), ({},), (None,)], "toggles map<string, boolean>")
    from veil.operators.audit import clean_toggles

    found = [r[0] for r in rows.select(clean_toggles(rows.toggles)).collect()]
    assert found == [{"email": True, "vin": False, "x" * 40: False}, {}, None]
