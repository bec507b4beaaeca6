"""Validators, detectors and thresholds on literal cases."""

import pytest
from pyspark.sql import functions as F

from veil.functions import validators as V
from veil.operators import detectors as D
from veil.operators.detect import accepts, find_matches

VALUES = [
    (V.valid_ssn, ["123-45-6789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]),
    (V.valid_itin, ["987-65-4321"], ["987-12-4321"]),
    (V.luhn, ["4111111111111111"], ["4111111111111112"]),
    (V.valid_card, ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], ["1234567812345670", "4111 11111 1111111"]),
    (V.valid_aba, ["021000021", "011000015"], ["021000022", "991000021"]),
    (V.valid_iban, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], ["GB82WEST12345698765433", "DE89 3704 0044 0532 0130"]),
    (V.valid_ein, ["12-3456789"], ["07-1234567", "00-1234567"]),
    (V.valid_vin, ["1M8GDM9AXKP042788"], ["1M8GDM9AYKP042788", "11111111111111111"]),
    (lambda s: V.valid_dob(s, 2025), ["04/18/1980"], ["13/01/1980", "04/18/2026", "4/18/80"]),
    (lambda s: V.valid_birth_date(s, 2025), ["1980-04-18", "April 18, 1980", "12/31/80"], ["1880-01-01", "1980-99-01"]),
    (V.valid_phone_us, ["+1 (415) 555-2671"], ["(015) 555-2671"]),
]


@pytest.mark.parametrize("check, good, bad", VALUES)
def test_validators(spark, check, good, bad):
    rows = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    assert [r.v for r in rows.where(F.coalesce(check(F.col("v")), F.lit(False)) != F.col("want")).collect()] == []


MATCHES = [
    ("SSN 123-45-6789", "ssn"), ("123 45 6789", "ssn"), ("spouse 987-65-4321", "itin"), ("EIN 12-3456789", "ein"), ("routing 021000021", "routing"),
    ("IBAN DE89 3704 0044 0532 0130 00", "iban"), ("card 4111 1111 1111 1111 on file", "card"), ("SSN ***-**-1234", "maskedLast4"), ("ending ••••1234", "maskedLast4"), ("born 04/18/1980", "dob"),
    ("Call (555) 010-4477 or 555-010-9911 or 555.010.2288", None), ("Ship to 94107-1234", None), ("Placed 03-14-2024, due 2024-05-02, paid 11.30.2023", None),
    ("Ref 7f3c9a2e-4b1d-4c8e-9a6f-0d2e5b7c1a93", None), ("checksum 5d41402abc4b2a76b9719d911017c592", None), ("order 112-4567890-1234567", None), ("123-45-6789-01", None), ("tracking 9400111899223197428490", None),
]


def test_matches(spark):
    rows = find_matches(spark.createDataFrame(MATCHES, "text string, want string")).collect()
    for r in rows:
        got = {m.pattern for m in r.matches}
        assert (r.want in got) if r.want else not got, r.text


CATALOG = [
    ("dl-ca", "DL D1234567", 1), ("dl-oh", "license AB123456", 1), ("phone-us", "call (415) 555-2671", 1), ("phone-us", "call (015) 555-2671", 0), ("email", "write to pat@example.com", 1),
    ("dob-any", "born April 18, 1980", 1), ("dob-any", "born 1980-04-18", 1), ("vin", "VIN 1M8GDM9AXKP042788", 1), ("insurance", "Tracking 1Z999AA10123456784", 0), ("insurance", "Policy ABC123456", 1),
    ("mrn", "tracking 9400111899223197428490", 0),
]


def test_catalog(spark):
    by_id = {d.id: d for d in D.CATALOG}
    for entry, text, n in CATALOG:
        assert len(find_matches(spark.createDataFrame([(text,)], "text string"), [by_id[entry]]).first().matches) == n, text


def test_accepts(spark):
    cases = [
        ("high", 0, "balanced", False, True), ("medium", 0, "balanced", False, False), ("medium", 1, "balanced", False, True), ("low", 1, "balanced", False, False), ("low", 2, "balanced", True, True),
        ("high", 1, "labeled-only", False, False), ("low", 2, "labeled-only", False, True), ("medium", 0, "aggressive", False, True), ("low", 0, "aggressive", False, False), ("low", 1, "aggressive", True, True), ("high", 0, "aggressive", True, False),
    ]
    for strength, bonus, sensitivity, gated, want in cases:
        assert spark.range(1).select(accepts(F.lit(strength), F.lit(bonus), sensitivity, F.lit(gated))).first()[0] == want
