"""Keyed identities: HMAC-SHA256 as a column of built-in functions, the same as any other implementation's.

The key is a parameter of the job. Only the two padded blocks derived from it enter a plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import WS
from .text import normalize_text

#: What the message begins with, by kind; a NUL keeps the kinds apart.
PREFIXES = {"text": "", "cover": "cover\0", "token": "token\0", "attr": "attr\0", "path": "path\0", "frame": "frame\0", "view": "view\0", "suggest": "suggest\0"}


def pads(key: bytes) -> tuple[str, str]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def hmac(message: Column, key: bytes) -> Column:
    inner, outer = pads(key)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def identity(kind: str, value: Column, key: bytes) -> Column:
    """The identity of a value: text and attr normalised, cover with its case, token trimmed and lowered."""
    if kind == "text":
        value = normalize_text(value)
    elif kind == "cover":
        value = F.trim(F.regexp_replace(value, f"[{WS}]+", " "))
    elif kind == "token":
        value = F.lower(F.trim(value))
    return hmac(F.concat(F.lit(PREFIXES[kind]), value), key)


def view_prefix(text: Column, length: Column, key: bytes) -> Column:
    """Identity of the first ``length`` characters that are not white space, in lower case."""
    packed = F.lower(F.regexp_replace(text, f"[{WS}]", ""))
    return hmac(F.concat(F.lit(PREFIXES["view"]), F.substring(packed, F.lit(1), length)), key)
