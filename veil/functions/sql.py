"""The scalar functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T
from . import validators as V
from .dialect import WS, quoted

#: name: (arguments, type, SQL of the result)
FUNCTIONS = {
    "valid_ssn": ("s string", "boolean", V.valid_ssn("s")),
    "valid_itin": ("s string", "boolean", V.valid_itin("s")),
    "valid_ein": ("s string", "boolean", V.valid_ein("s")),
    "valid_aba": ("s string", "boolean", V.valid_aba("s")),
    "luhn": ("s string", "boolean", V.luhn("s")),
    "card_brand": ("s string", "string", V.card_brand("s")),
    "valid_card": ("s string", "boolean", V.valid_card("s")),
    "valid_iban": ("s string", "boolean", V.valid_iban("s")),
    "valid_account": ("s string", "boolean", V.valid_account("s")),
    "valid_dob": ("s string, as_of_year int", "boolean", V.valid_dob("s", "as_of_year")),
    "valid_birth_date": ("s string, as_of_year int", "boolean", V.valid_birth_date("s", "as_of_year")),
    "valid_vin": ("s string", "boolean", V.valid_vin("s")),
    "valid_phone_us": ("s string", "boolean", V.valid_phone_us("s")),
    "normalize_text": ("s string", "string", f"lower(trim(regexp_replace(s, {quoted(f'[{WS}]+')}, ' ')))"),
    "normalize_label": ("s string", "string", T.label_sql("s")),
    "is_tracking": ("s string, before string", "boolean", T.is_tracking("s", "before")),
    "bullets": ("s string", "string", f"regexp_replace(s, {quoted(f'[^{WS}]')}, '•')"),
    "mask_value": ("s string", "string", "repeat('•', length(s))"),
}


def register_sql(spark: SparkSession, prefix: str = "veil_") -> list[str]:
    """Temporary functions for SQL, all of built-ins; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body}")
    return [f"{prefix}{name}" for name in FUNCTIONS]
