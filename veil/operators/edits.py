"""Edits: a run of words replaced in texts and attributes, everywhere or in the edited row only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import changed_run, collapse, leaks, run_regex, tokens_of

#: Edits in one plan; more are applied in several passes.
EDITS_MOST = 200
# Attributes that lead somewhere.
NAVIGATION = ["href", "src", "action", "formaction", "srcset", "ping", "poster", "data", "cite", "background", "xlink:href"]


def spreads(original: str, now: str) -> bool:
    """May an edit apply everywhere? It has three characters, and its replacement does not contain it."""
    return len("".join(original.split())) >= 3 and original.lower() not in now.lower()


def apply_edits(texts: DataFrame, edits: list[tuple[str, str, bool]]) -> DataFrame:
    """texts (…, text) with ``edited`` and ``copies``: (original, now, everywhere) in order.

    An edit that is not for everywhere, or may not spread, only applies to a row that is the original as a whole.
    """
    if len(edits) > EDITS_MOST:
        raise ValueError(f"more than {EDITS_MOST} edits in one pass")
    edited, copies = F.col("text"), F.lit(0)
    for original, now, everywhere in edits:
        pattern = run_regex(original)
        new = F.regexp_replace(edited, F.lit(pattern), F.lit(now.replace("\\", "\\\\").replace("$", "\\$")))
        here = F.lit(everywhere and spreads(original, now)) | (collapse(edited) == " ".join(original.split()))
        copies = copies + F.when(here, F.regexp_count(edited, F.lit(pattern))).otherwise(0)
        edited = F.when(here, new).otherwise(edited)
    return texts.withColumn("edited", edited).withColumn("copies", copies.cast("int"))


def mirror_attrs(attrs: Column, original: str, now: str) -> Column:
    """Attributes with the run replaced, or blanked where only its tokens are; never navigation or handlers."""
    words, runs = tokens_of(F.lit(original))
    pattern = run_regex(original)

    def one(k: Column, v: Column) -> Column:
        safe = ~k.isin(NAVIGATION) & ~k.startswith("on")
        replaced = F.regexp_replace(v, F.lit(pattern), F.lit(now.replace("\\", "\\\\").replace("$", "\\$")))
        return F.when(safe & v.rlike(pattern), replaced).when(safe & leaks(v, words, runs), "").otherwise(v)

    return F.transform_values(attrs, one)


_RUN = S.StructType([S.StructField("original", S.StringType()), S.StructField("now", S.StringType())])


def changed_runs(before: Column | str, after: Column | str) -> Column:
    """(original, now): what of a text changed in whole words, both null where only white space did; in Arrow batches."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [changed_run(x or "", y or "") or (None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["original", "now"])

    return F.pandas_udf(run, _RUN)(before, after)


def remaining(edited: DataFrame, original: str) -> DataFrame:
    """How many copies of an original are left."""
    return edited.agg(F.sum(F.regexp_count("edited", F.lit(run_regex(original)))).cast("long").alias("remaining"))


