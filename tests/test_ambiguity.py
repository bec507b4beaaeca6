"""Patterns that a matcher could take long over, and patterns that it does not."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veil.operators import detectors as D
from veil.operators import teach
from veil.operators.ambiguity import ambiguity, repeated_shapes


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("(a+)+$", "exponential"), ("(a|a)*", "exponential"), ("(a|aa)+b", "exponential"), (r"(?:\w+\s?)+$", "exponential"), (r"([a-z]+\d*)*x", "exponential"),
        (r"(?:[a-c]|[b-d])+x", "exponential"), (r"(?:ab|a(?:b))*", "exponential"), ("(?:a*)*b", "exponential"), (r"(?:a?b?)+c", "exponential"),
        (r"\d+\d+$", "polynomial"), (r"\w*x?\d*y", "polynomial"), (r"\s+\s*;", "polynomial"), (r".*,.*,x", "polynomial"), (r"[A-Z0-9]+-?[0-9]+", "polynomial"),
        (r"\d+-\d+", None), ("(?:ab|cd)+e", None), (r"[a-z]+\d+", None), (r"(?:\d{3}-){2}\d{4}", None), (r"\b[A-Z]{2}-\d{7}\b", None), ("(?:a|b)*c", None), (r"[a-z]+(?: [a-z]+)*!", None), (r"(?<!\d)\d{9}(?!\d)", None),
    ],
)
def test_ambiguity(pattern, want):
    assert ambiguity(pattern) == want


def test_case_counts():
    assert ambiguity("(?:a|A)+b") is None and ambiguity("(?:a|A)+b", ignore_case=True) == "exponential"


def test_the_catalogue_is_accepted():
    for d in (*D.BUILTIN, *D.CATALOG):
        began = time.time()
        assert ambiguity(d.pattern) != "exponential", d.id
        assert time.time() - began < 20


def test_shapes():
    assert repeated_shapes(r"(\d+)*x") == "nested quantifier" and repeated_shapes("(a|b)*") == "repeated alternation" and repeated_shapes(r"((?:a|b)c)+") == "repeated alternation"
    assert repeated_shapes(r"(?:\d{3}-){2}") is None and repeated_shapes(r"(?:a|b){2}") is None and repeated_shapes(r"(?:ab)?c+") is None and repeated_shapes(r"\(a+\)+") is None


@pytest.mark.parametrize("bad, why", [(r"\d+\d+$", "polynomial time"), ("(a+)+$", "nested quantifier"), ("(a|aa)+b", "repeated alternation"), (r"(\d)\1", "backreference"), ("a*", "empty match"), ("([a-z", "syntax"), ("x" * 201, "length"), ("SSN 123456789", "literal digits"), ("", "length"), (r"[a-z]*[a-m]*x", "polynomial time")])
def test_refused(bad, why):
    assert teach.check_regex(bad) == teach.Checked(False, why)


def test_what_is_accepted_is_fast():
    """The adversarial texts, on every pattern of this file that is accepted."""
    texts = ["a" * 3000 + "!", "1" * 3000 + "x", "a1-" * 1000 + "\0", " " * 3000 + "#"]
    for pattern in (r"\d+-\d+x", r"[a-z]+\d+", r"(?:\d{3}-){2}\d{4}", r"\b[A-Z]{2}-\d{7}\b", r"(?<!\d)\d{9}(?!\d)"):
        assert teach.check_regex(pattern).ok
        began = time.time()
        for text in texts:
            list(re.finditer(pattern, text))
        assert time.time() - began < 2


def test_compiled_detectors(spark):
    """Unsafe patterns are left out, the others run."""
    rows = spark.createDataFrame([("1", "one", r"P-\d{6}", None, ["policy"], "medium"), ("2", "two", r"\d+\d+$", None, None, None), ("3", "three", "(", None, None, None)], "id string, name string, regex string, flags string, labels array<string>, strength string")
    found = teach.compile_detectors(rows)
    assert [d.id for d in found] == ["custom:1"]
    from veil.operators.detect import find_matches

    texts = spark.createDataFrame([("policy P-123456",)], "text string")
    assert [(m.start, m.end) for m in find_matches(texts, found).select(F.explode("matches").alias("m")).select("m.*").collect()] == [(7, 15)]
