"""Redaction, spans, edits and shapes on literal cases."""

import random
import re
import time

from pyspark.sql import functions as F

from veil.functions import text as T
from veil.functions import urls as U
from veil.operators import edits, redact, teach, windows
from veil.operators.detect import detect, exploded
from veil.operators.matching import SPAN, match_all, merge_ranges
from veil.plans import reports


def test_ranges_keep_length_and_restore(spark):
    text = "987-65-4321 and this inline span wraps across several lines"
    df = spark.createDataFrame([(1, 0, text)], "doc_key int, block_id int, text string")
    at = text.index("several")
    spans = F.lit([[at, at + 7], [0, 11], [5, 11], [200, 300]])
    ranges = F.transform(spans, lambda r: F.struct(r[0].alias("start"), r[1].alias("end"))).cast(SPAN)
    got = df.select("doc_key", "block_id", redact.redact_ranges(F.col("text"), ranges).alias("redacted"))
    out = got.first().redacted
    assert out == "•" * 11 + text[11:at] + "•" * 7 + text[at + 7 :] and len(out) == len(text)
    assert redact.restore(got, df, ["doc_key", "block_id"]).first().text == text


def test_redaction_is_idempotent_and_partition_free(spark):
    texts = ["SSN 123-45-6789 and card 4111 1111 1111 1111", "plain", "routing: 021000021", "é 😀 SSN 123-45-6789", ""]
    df = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "doc_key string, block_id int, text string")
    once = redact.redact_detected(df).cache()
    again = redact.redact_detected(once.select("doc_key", "block_id", F.col("redacted").alias("text")))
    assert again.where("n_hits > 0").isEmpty()
    rows = {r.doc_key: r.redacted for r in once.collect()}
    assert rows["0"] == "SSN ••••••••••• and card •••• •••• •••• ••••" and rows["3"] == "é 😀 SSN •••••••••••" and rows["2"] == "routing: •••••••••"
    assert rows == {r.doc_key: r.redacted for r in redact.redact_detected(df.repartition(3)).collect()}
    best = exploded(detect(df)).where("doc_key = '0'").collect()
    assert [(b.pattern, b.bonus, b.score) for b in best] == [("ssn", 3, 6)] or [(b.pattern, b.bonus) for b in best] == [("ssn", 1)]


def test_match_offsets_are_code_points(spark):
    rows = spark.createDataFrame([("😀12 345",)], "t string").select(match_all(F.col("t"), "[0-9]+").alias("m")).first().m
    assert [(m.start, m.end, m.text) for m in rows] == [(1, 3, "12"), (4, 7, "345")]


def test_snap_to_tokens(spark):
    df = spark.createDataFrame([("one two three four",)], "t string")
    spans = F.expr("array(struct(5 as start, 6 as end), struct(9 as start, 10 as end))").cast(SPAN)
    assert [(s.start, s.end) for s in df.select(redact.snap_to_tokens(F.col("t"), spans).alias("s")).first().s] == [(4, 13)]


def test_url_patterns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(U.sanitize_path(F.lit("/c/42/orders/INV-20231/lines"))) == "/c/*/orders/*/lines"
    assert one(U.sanitize_path(F.lit("/users/jdoe-55512345/profile"))) == "/users/*/profile"
    assert one(U.prefix_pattern(F.lit("/accounts/123456789/tx"))) == "/accounts/*/**"
    cases = [("/clients/*", "/clients/456", True), ("/clients/*", "/clients", False), ("/clients/*", "/clients/456/edit", False), ("/clients/**", "/clients", True), ("/clients/**", "/clients/1/2/3", True), ("/", "/", True), ("/a.b", "/axb", False), ("/**", "/x", True)]
    for pattern, path, want in cases:
        assert one(U.matches_path(F.lit(pattern), F.lit(path))) == want, (pattern, path)


def test_edits(spark):
    assert T.changed_run("the quick fox", "the slow fox") == ("quick", "slow") and T.changed_run("a  b", "a b") is None
    df = spark.createDataFrame([("Old Name here, old name; Old  Name.",), ("Older Names",), ("Old Name",)], "text string")
    rows = edits.apply_edits(df, [("Old Name", "New", True)]).collect()
    assert [(r.edited, r.copies) for r in rows] == [("New here, old name; New.", 2), ("Older Names", 0), ("New", 1)]
    local = edits.apply_edits(df, [("Old Name", "New", False)]).collect()
    assert [r.copies for r in local] == [0, 0, 1]


def test_shapes_and_templates(spark):
    examples = [("AB-1234567", "Policy"), ("MRN 00912345", "MRN"), ("123456", None), ("!!", None), ("ab", None), ("Xy12", None)]
    rows = teach.derive_from_example(spark.createDataFrame(examples, "example string, label string")).collect()
    assert [(r.regex, r.description, r.strength, r.error) for r in rows] == [
        (r"\b[A-Z]{2}-\d{7}\b", "2 letters, 7 digits", "high", None), (r"\b\d{8}\b", "8 digits", "medium", None), (r"\b\d{6}\b", "6 digits", "low", None),
        (None, None, None, "no letters or digits"), (None, None, None, "too short"), (r"\b[A-Za-z]{2}\d{2}\b", "2 letters, 2 digits", "medium", None),
    ]
    assert teach.template_to_regex("AA-####") == r"\b[A-Z]{2}-\d{4}\b" and teach.template_to_regex(r"\A#*") == r"\bA\d+\b"
    for bad in (r"(a+)+", r"(a|b)*", r"(\d)\1", "12345", "a*", "x" * 201, "("):
        assert not teach.check_regex(bad).ok, bad
    assert teach.check_regex(r"\b[A-Z]{2}-\d{7}\b").ok


def test_find_catalog(spark):
    found = teach.find_catalog(spark.createDataFrame([("insurance policy numbers",), ("driver licence texas",)], "query string")).where("place = 1").collect()
    assert {r["query"]: r.entry for r in found} == {"insurance policy numbers": "insurance", "driver licence texas": "dl-tx"}


def test_redacted_leaks_are_reported(spark, tmp_path):
    """A number that no detector accepts stays readable in the redacted text, and the audit says so."""
    texts = ["SSN 123-45-6789 is hidden", "serial 1234567890123456789012 stays", "plain\nref 98-7654321x, code 555666777888"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert reports.g01_redacted_is_clean(spark, str(tmp_path)).first().leaks == 2
    assert [tuple(r) for r in reports.g01_redacted_leaks(spark, str(tmp_path)).collect()] == [("long number", 2)]


def test_catalogue_matches_of_a_long_block(spark):
    """Matches after 50,000 characters and after the 500th are found and redacted; the bound is an option."""
    from veil.operators.detect import find_matches
    from veil.operators.detectors import CATALOG

    email = [d for d in CATALOG if d.id == "email"]
    mails = " ".join(f"u{i}@mail.test.org" for i in range(600))
    df = spark.createDataFrame([("many", 0, mails), ("far", 0, "word " * 12_000 + "late@mail.test.org")], "doc_key string, block_id int, text string")
    out = {r.doc_key: r for r in redact.redact_detected(df, detectors=email).collect()}
    assert out["many"].n_hits == 600 and out["far"].n_hits == 1
    assert "@" not in out["many"].redacted + out["far"].redacted
    bound = {r.doc_key: r.n for r in find_matches(df, email, limited=True).select("doc_key", F.size("matches").alias("n")).collect()}
    assert bound == {"many": 500, "far": 0}


def _plain_merge(ranges, n):
    out = []
    for a, b in sorted((max(a, 0), min(b, n)) for a, b in ranges):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_merging_and_redaction_as_plain(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        text = "".join(rng.choice("ab 😀\n") for _ in range(rng.choice([0, 5, 60, 900])))
        rows.append((text, [(a := rng.randint(-5, len(text) + 5), a + rng.randint(-2, 12)) for _ in range(rng.choice([0, 1, 4, 40]))]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, r array<struct<start: int, end: int>>")
    got = {x.i: x for x in df.select("i", merge_ranges(F.col("r"), F.length("text")).alias("m"), redact.redact_ranges(F.col("text"), F.col("r")).alias("t")).collect()}
    for i, (text, ranges) in enumerate(rows):
        want = _plain_merge(ranges, len(text))
        assert [list(x) for x in got[i].m] == want
        hidden = list(text)
        for a, b in want:
            hidden[a:b] = [c if c.isspace() else "•" for c in hidden[a:b]]
        assert got[i].t == "".join(hidden)


def test_snapping_as_plain(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(120):
        text = "".join(rng.choice("abc  \n") for _ in range(rng.choice([1, 8, 60, 700])))
        ranges = sorted((a := rng.randrange(len(text)), min(len(text), a + rng.randint(1, 6))) for _ in range(rng.choice([1, 3, 30])))
        rows.append((text, ranges))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, r array<struct<start: int, end: int>>")
    got = {x.i: [tuple(y) for y in x.s] for x in df.select("i", redact.snap_to_tokens(F.col("text"), F.col("r")).alias("s")).collect()}
    for i, (text, ranges) in enumerate(rows):
        grown = []
        for a, b in ranges:
            while a > 0 and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            grown.append((a, b))
        want = []
        for a, b in sorted(grown):
            if want and (a <= want[-1][1] or text[want[-1][1] : a].isspace()):
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert got[i] == want, (text, ranges)


def test_locate_exact_as_plain(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab .\\E") for _ in range(rng.choice([3, 40, 300]))), "".join(rng.choice("ab.\\E") for _ in range(rng.randint(1, 3))), rng.randint(0, 80)) for i in range(200)]
    rows += [(900, "aaaa", "aa", 2), (901, "abc", " ", 0), (902, "é😀é😀", "😀", 9), (903, "", "a", 0)]
    got = {r.i: r["at"] for r in windows.locate_exact(spark.createDataFrame(rows, "i int, text string, needle string, near int"), ["i"]).collect()}
    want = {}
    for i, text, needle, near in rows:
        bare, find = text.replace(" ", ""), needle.replace(" ", "")
        at = [k for k in range(len(bare) - len(find) + 1) if find and bare.startswith(find, k)]
        if at:
            want[i] = min(at, key=lambda k: (abs(k - near), k))
    assert got == want


def _redacted_in(spark, n):
    text = " ".join(f"tel 555-010-{1000 + i % 9000} card 4111 1111 1111 1111, SSN 123-45-{1000 + i % 9000}." for i in range(n))
    df = spark.createDataFrame([("d", 0, text)], "doc_key string, block_id int, text string")
    began = time.time()
    row = redact.redact_detected(df).first()
    return text, row, time.time() - began


def test_long_blocks_take_time_in_proportion(spark):
    """Ten thousand matches and look-alikes in one line: every one is right, and twice as many take about twice as long."""
    _redacted_in(spark, 50)
    _, _, once = _redacted_in(spark, 2500)
    text, row, twice = _redacted_in(spark, 5000)
    assert row.n_hits == 10_000 and row.redacted == re.sub(r"4111 1111 1111 1111|123-45-\d{4}", lambda m: re.sub(r"\S", "•", m[0]), text)
    assert twice < 3 * once + 2
