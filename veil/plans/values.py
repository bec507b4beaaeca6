"""Queries of the validators, over identifiers made from the keys of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import validators as V
from ..operators.detectors import YEAR
from ..sources.readers import table
from .registry import query

#: name: (value in Spark SQL, value in DuckDB)
_VALUES = {
    "nine": ("lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0')", "lpad(cast(o_orderkey * 7919 % 1000000000 as varchar), 9, '0')"),
    "spread": ("lpad(cast(o_orderkey * 48271 * 7919 % 1000000000 as string), 9, '0')", "lpad(cast(o_orderkey * 48271 * 7919 % 1000000000 as varchar), 9, '0')"),
    "card": (
        "concat(element_at(array('4', '51', '37', '6011', '36', '3530', '62'), cast(o_orderkey % 7 as int) + 1), lpad(cast(o_orderkey * 7919 as string), if(o_orderkey % 7 = 2, 13, 14), '0'))",
        "concat((['4', '51', '37', '6011', '36', '3530', '62'])[o_orderkey % 7 + 1], lpad(cast(o_orderkey * 7919 as varchar), CASE WHEN o_orderkey % 7 = 2 THEN 13 ELSE 14 END, '0'))",
    ),
    "iban": (
        "concat(element_at(array('DE', 'GB', 'NO'), cast(o_orderkey % 3 as int) + 1), lpad(cast(o_orderkey % 97 + 2 as string), 2, '0'), lpad(cast(o_orderkey * 7919 as string), element_at(array(18, 18, 11), cast(o_orderkey % 3 as int) + 1), '0'))",
        "concat((['DE', 'GB', 'NO'])[o_orderkey % 3 + 1], lpad(cast(o_orderkey % 97 + 2 as varchar), 2, '0'), lpad(cast(o_orderkey * 7919 as varchar), ([18, 18, 11])[o_orderkey % 3 + 1], '0'))",
    ),
    "account": ("concat(repeat('A', cast(o_orderkey % 5 as int)), cast(o_orderkey * 7919 as string))", "concat(repeat('A', (o_orderkey % 5)::INT), cast(o_orderkey * 7919 as varchar))"),
    "date": ("concat_ws('/', cast(o_orderkey % 15 as string), cast(o_orderkey % 35 as string), cast(1890 + o_orderkey % 140 as string))", "concat_ws('/', cast(o_orderkey % 15 as varchar), cast(o_orderkey % 35 as varchar), cast(1890 + o_orderkey % 140 as varchar))"),
    "birth": (
        "if(o_orderkey % 2 = 0, concat_ws('-', cast(1890 + o_orderkey % 140 as string), cast(o_orderkey % 15 as string), cast(o_orderkey % 35 as string)), concat_ws('/', cast(o_orderkey % 15 as string), cast(o_orderkey % 35 as string), lpad(cast(o_orderkey % 100 as string), 2, '0')))",
        "CASE WHEN o_orderkey % 2 = 0 THEN concat_ws('-', cast(1890 + o_orderkey % 140 as varchar), cast(o_orderkey % 15 as varchar), cast(o_orderkey % 35 as varchar)) ELSE concat_ws('/', cast(o_orderkey % 15 as varchar), cast(o_orderkey % 35 as varchar), lpad(cast(o_orderkey % 100 as varchar), 2, '0')) END",
    ),
    "vin": (
        "concat('1M8GDM9A', if(o_orderkey % 11 = 10, 'X', cast(o_orderkey % 11 as string)), 'KP', lpad(cast(o_orderkey % 1000000 as string), 6, '0'))",
        "concat('1M8GDM9A', CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE cast(o_orderkey % 11 as varchar) END, 'KP', lpad(cast(o_orderkey % 1000000 as varchar), 6, '0'))",
    ),
    "phone": ("concat('(', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ') ', lpad(cast(o_orderkey % 997 as string), 3, '0'), '-', lpad(cast(o_orderkey % 10000 as string), 4, '0'))", "concat('(', lpad(cast(o_orderkey % 1000 as varchar), 3, '0'), ') ', lpad(cast(o_orderkey % 997 as varchar), 3, '0'), '-', lpad(cast(o_orderkey % 10000 as varchar), 4, '0'))"),
}

_N = lambda a, n: f"CAST(substr(value, {a}, {n}) AS INT)"
_LUHN = "list_sum(list_transform(range(1, len(value) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(value[len(value) + 1 - i] AS INT) ELSE (2 * CAST(value[len(value) + 1 - i] AS INT)) % 10 + (2 * CAST(value[len(value) + 1 - i] AS INT)) // 10 END)) % 10 = 0"
_BRAND = f"""CASE WHEN value[1] = '4' AND len(value) IN (13, 16, 19) THEN 'visa'
  WHEN ({_N(1, 2)} BETWEEN 51 AND 55 OR {_N(1, 4)} BETWEEN 2221 AND 2720) AND len(value) = 16 THEN 'mastercard'
  WHEN {_N(1, 2)} IN (34, 37) AND len(value) = 15 THEN 'amex'
  WHEN ({_N(1, 4)} = 6011 OR {_N(1, 2)} = 65 OR {_N(1, 3)} BETWEEN 644 AND 649 OR {_N(1, 6)} BETWEEN 622126 AND 622925) AND len(value) BETWEEN 16 AND 19 THEN 'discover'
  WHEN ({_N(1, 3)} BETWEEN 300 AND 305 OR {_N(1, 2)} IN (36, 38, 39)) AND len(value) BETWEEN 14 AND 19 THEN 'diners'
  WHEN {_N(1, 4)} BETWEEN 3528 AND 3589 AND len(value) BETWEEN 16 AND 19 THEN 'jcb'
  WHEN {_N(1, 2)} = 62 AND len(value) BETWEEN 16 AND 19 THEN 'unionpay' END"""
_SSN = f"{_N(1, 3)} > 0 AND {_N(1, 3)} <> 666 AND {_N(1, 3)} < 900 AND {_N(4, 2)} > 0 AND {_N(6, 4)} > 0"
_ITIN = f"value[1] = '9' AND {_N(6, 4)} > 0 AND ({_N(4, 2)} BETWEEN 50 AND 65 OR {_N(4, 2)} BETWEEN 70 AND 88 OR {_N(4, 2)} BETWEEN 90 AND 92 OR {_N(4, 2)} BETWEEN 94 AND 99)"
_DOB = "coalesce(try_cast(split_part(value, '/', 1) AS INT) BETWEEN 1 AND 12 AND try_cast(split_part(value, '/', 2) AS INT) BETWEEN 1 AND 31 AND length(split_part(value, '/', 3)) = 4 AND try_cast(split_part(value, '/', 3) AS INT) BETWEEN 1900 AND 2025, false)"
_PARTS = "list_transform(string_split(value, '-'), lambda x: try_cast(x AS INT))"

#: name: (values, column function, SQL over value)
_CHECKS = {
    "v01_valid_ssn": ("nine", V.valid_ssn, _SSN),
    "v02_valid_itin": ("spread", V.valid_itin, _ITIN),
    "v03_valid_ein": ("spread", V.valid_ein, f"{_N(1, 2)} NOT IN (0, 7, 8, 9, 17, 18, 19, 28, 29, 49, 69, 70, 78, 79, 89, 96, 97) AND {_N(3, 7)} > 0"),
    "v04_valid_aba": (
        "spread", V.valid_aba,
        f"value <> '000000000' AND ({_N(1, 2)} BETWEEN 0 AND 12 OR {_N(1, 2)} BETWEEN 21 AND 32 OR {_N(1, 2)} BETWEEN 61 AND 72 OR {_N(1, 2)} = 80) AND (3 * ({_N(1, 1)} + {_N(4, 1)} + {_N(7, 1)}) + 7 * ({_N(2, 1)} + {_N(5, 1)} + {_N(8, 1)}) + {_N(3, 1)} + {_N(6, 1)} + {_N(9, 1)}) % 10 = 0",
    ),
    "v05_luhn": ("card", V.luhn, f"len(value) >= 12 AND {_LUHN}"),
    "v06_card_brand": ("card", V.card_brand, _BRAND),
    "v07_valid_card": ("card", V.valid_card, f"len(value) BETWEEN 13 AND 19 AND replace(value, value[1], '') <> '' AND ({_BRAND}) IS NOT NULL AND {_LUHN}"),
    "v08_valid_iban": (
        "iban", V.valid_iban,
        "list_reduce(list_concat([0], list_transform(string_split(concat(substr(value, 5), substr(value, 1, 4)), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (CASE WHEN v > 9 THEN a * 100 ELSE a * 10 END + v) % 97) = 1 AND len(value) = CASE substr(value, 1, 2) WHEN 'NO' THEN 15 ELSE 22 END",
    ),
    "v09_valid_account": ("account", V.valid_account, "len(regexp_replace(value, '[^0-9]', '', 'g')) >= 6 AND len(regexp_replace(value, '[^0-9]', '', 'g')) >= 0.8::DOUBLE * len(value)"),
    "v10_valid_dob": ("date", lambda s: V.valid_dob(s, YEAR), _DOB),
    "v11_valid_birth_date": (
        "birth", lambda s: V.valid_birth_date(s, YEAR),
        f"CASE WHEN value LIKE '%-%' THEN ({_PARTS})[1] BETWEEN 1900 AND 2025 AND len(list_filter({_PARTS}, lambda x: x <> ({_PARTS})[1] AND x NOT BETWEEN 1 AND 31)) = 0 ELSE try_cast(split_part(value, '/', 1) AS INT) BETWEEN 1 AND 12 AND try_cast(split_part(value, '/', 2) AS INT) BETWEEN 1 AND 31 END",
    ),
    "v12_valid_vin": (
        "vin", V.valid_vin,
        "value[9] = (list_transform([list_sum(list_transform(range(1, 18), lambda i: CAST(translate(value, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789')[i] AS INT) * ([8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])[i])) % 11], lambda m: CASE WHEN m = 10 THEN 'X' ELSE CAST(m::INT AS VARCHAR) END))[1]",
    ),
    "v13_valid_phone_us": ("phone", V.valid_phone_us, "regexp_matches(regexp_replace(value, '[^0-9]', '', 'g'), '^[2-9][0-9]{2}[2-9][0-9]{6}$')"),
    "v14_digit_counts": ("account", V.digits_between(8, 15), "len(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
}


def _register(name: str, values: str, check, sql: str) -> None:
    spark_value, duck_value = _VALUES[values]

    @query(name, f"SELECT o_orderkey, value, {sql} AS result FROM (SELECT o_orderkey, {duck_value} AS value FROM orders)")
    def run(spark, sf_dir):
        made = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(spark_value).alias("value"))
        return made.select("o_orderkey", "value", check(F.col("value")).alias("result"))


for _name, (_values, _check, _sql) in _CHECKS.items():
    _register(_name, _values, _check, _sql)
