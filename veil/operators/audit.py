"""Audits and reports: leaks in nested records, secrets in lines, the audit log, hit and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import B, WS, quoted
from .matching import matches_sql

# What an identifier looks like in a stored record.
LEAKS = {
    "ssn": rf"{B}[0-9]{{3}}[- ][0-9]{{2}}[- ][0-9]{{4}}{B}",
    "ein": rf"{B}[0-9]{{2}}-[0-9]{{7}}{B}",
    "long number": rf"{B}[0-9]{{9,}}{B}",
    "card": rf"{B}(?:[0-9][ -]?){{13,19}}{B}",
}
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_HEX64 = r"^[0-9a-f]{64}\z"
# Fields that hold keyed hashes; test identifiers; reserved mail domains.
HMAC_FIELDS = {"textHmac", "keyHmac", "idHmac", "testIdHmac", "nameHmac", "dismissedSuggestions", "pathHmac", "urlHmac", "viewHmac", "coverHmac", "tokenHmacs"}
ALLOWED = ["123-45-6789", "987-65-4321", "111-22-3333", "000-00-0000", "444-55-6666", "12-3456789"]
_RESERVED = r"(?i)@(?:users\.noreply\.github\.com|example\.(?:com|org|net)|[A-Za-z0-9_.-]+\.(?:example|test|invalid|localhost))\z"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# What keys look like; before each a test without which there is none.
KEYS = {
    "sk key": ("contains(text, 'sk-')", rf"{B}sk-[A-Za-z0-9_-]{{20,}}"),
    "repository token": ("contains(text, 'gh')", rf"{B}gh[po]_[A-Za-z0-9]{{20,}}"),
    "cloud access key": ("contains(text, 'AKIA')", rf"{B}AKIA[0-9A-Z]{{16}}{B}"),
    "hex secret": ("rlike(text, '[0-9a-fA-F]{32}')", rf"(?i)(?:key|token|secret)[A-Za-z0-9_-]*[\"']?[{WS}]*[:=]?[{WS}]*[\"']?[0-9a-f]{{32,}}"),
}
#: Paths that hold no text of a person's, and those that hold test data.
SKIPPED = r"(?i)(?:^|/)(?:node_modules|vendor|build|dist)/|(?:^|/)[^/]*lock\.(?:yaml|json)\z|\.(?:png|jpe?g|gif|ico|webp|woff2?|ttf|otf|zip|crx|pdf)\z"
TEST_FILES = "^(?:fixtures|tests)/"
ACTIONS = ["session-start", "session-end", "auto-lock", "auto-unlock", "unlock-refused", "canvas-page"]


def _leak(value: Column) -> Column:
    found = F.when(value.rlike(_UUID), None)
    for name, pattern in LEAKS.items():
        found = found.when(value.rlike(pattern), name)
    return found


def leak_columns(schema: T.StructType) -> list[tuple[str, Column]]:
    """(path, pattern found or null) for every string in a nested record, from its schema."""
    out: list[tuple[str, Column]] = []

    def visit(kind: T.DataType, path: str, get, exempt: bool) -> None:
        if isinstance(kind, T.StringType):
            out.append((path, get(lambda v: F.when(F.lit(exempt) & v.rlike(_HEX64), None).otherwise(_leak(v)))))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                inner = lambda test, name=f.name: get(lambda v: test(v[name]))
                visit(f.dataType, f"{path}.{f.name}" if path else f.name, inner, f.name in HMAC_FIELDS)
        elif isinstance(kind, T.ArrayType):
            many = lambda test: get(lambda v: F.try_element_at(F.array_compact(F.transform(v, lambda x: test(x))), F.lit(1)))
            visit(kind.elementType, f"{path}[]", many, exempt)
        elif isinstance(kind, T.MapType):
            visit(kind.valueType, f"{path}{{}}", lambda test: get(lambda v: F.try_element_at(F.array_compact(F.transform(F.map_values(v), lambda x: test(x))), F.lit(1))), exempt)

    for f in schema.fields:
        visit(f.dataType, f.name, lambda test, name=f.name: test(F.col(f"`{name}`")), f.name in HMAC_FIELDS)
    return out


def leak_audit(df: DataFrame, id_column: str) -> DataFrame:
    """(id, path, pattern): every field of every record that looks like an identifier."""
    fields = [F.struct(F.lit(path).alias("path"), test.alias("pattern")) for path, test in leak_columns(df.schema) if path != id_column]
    found = df.select(F.col(id_column).alias("id"), F.explode(F.array(*fields)).alias("x"))
    return found.select("id", "x.*").where("pattern is not null")


def guarded(df: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(storable rows, dropped ids): a row with any leak is not stored."""
    leaking = F.coalesce(*[test for path, test in leak_columns(df.schema) if path != id_column]).isNotNull()
    return df.where(~leaking), df.where(leaking).select(id_column)


def secret_scan(lines: DataFrame, skip: str = SKIPPED, tests: str = TEST_FILES) -> DataFrame:
    """lines (path, line_no, text) to (path, line_no, kind, shown): keys everywhere, identifiers and emails outside tests.

    skip, tests: patterns of paths that are not read, and of those that hold test data.
    """

    def found(kind: str, pattern: str, need: str, keep: str | None = None, cut: bool = False) -> str:
        hits = matches_sql("text", pattern, need)
        if keep is not None:
            hits = f"filter({hits}, m -> not test and {keep})"
        return f"transform({hits}, m -> named_struct('kind', {quoted(kind)}, 'shown', {"concat(substring(m.text, 1, 12), '...')" if cut else 'm.text'}))"

    allowed = f"m.text not in ({', '.join(map(quoted, ALLOWED))})"
    parts = [found(k, p, need, cut=True) for k, (need, p) in KEYS.items()]
    parts += [
        found("ssn", rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{B}", "rlike(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}')", allowed),
        found("ein", rf"{B}[0-9]{{2}}-[0-9]{{7}}{B}", "rlike(text, '[0-9]{2}-[0-9]{7}')", allowed),
        found("email", _EMAIL, "contains(text, '@')", f"not rlike(m.text, {quoted(_RESERVED)})"),
    ]
    ready = lines.where(~F.col("path").rlike(skip) & ~F.col("text").contains("\0")).withColumn("test", F.col("path").rlike(tests))
    # an outer explode: a plain one makes the optimizer test the hits below it, which finds them twice
    shown = ready.select("path", "line_no", F.explode_outer(F.expr(f"concat({', '.join(parts)})")).alias("x"))
    return shown.where("x is not null").select("path", "line_no", "x.*")


def valid_audit(log: DataFrame) -> DataFrame:
    """Audit rows (ts, action, origin, reason) with a time and a known action, texts cut to their bounds."""
    good = log.where(F.col("ts").isNotNull() & F.col("action").isin(ACTIONS))
    return good.withColumn("origin", F.substring("origin", 1, 200)).withColumn("reason", F.substring("reason", 1, 60))


def audit_summary(log: DataFrame) -> DataFrame:
    return valid_audit(log).groupBy("action", "origin").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def scan_stats(blocks: DataFrame, hits: DataFrame, cap: int = 20_000) -> DataFrame:
    """Blocks, candidates, detections and truncation of each document, from blocks (doc_key, text) and hits (doc_key)."""
    enough = F.col("text").rlike("(?:[0-9][^0-9]*){4}")
    by_doc = blocks.groupBy("doc_key").agg(F.count("*").alias("blocks"), F.count_if(enough).alias("candidates"), (F.count("*") > cap).alias("truncated"))
    found = hits.groupBy("doc_key").agg(F.count("*").alias("detections"))
    return by_doc.join(found, "doc_key", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))


def hit_report(hits: DataFrame, log_k: int | None = None) -> DataFrame:
    """Hits (source, pattern, strength, doc_key) by source, pattern and strength with all subtotals, in one pass over hits.

    n counts hits and docs different documents (a null doc_key is none). A document has few leaves, whatever its hits:
    these are counted first and the subtotals are made from the leaves, so no hit is copied for a subtotal. log_k: docs from
    sketches of 2^log_k registers, one for each leaf, merged for the subtotals; the estimate's standard error is about
    0.83 / sqrt(2^log_k) (1.3 % at 12), and documents are not shuffled at all. No hits give no rows.
    """
    keys = ["source", "pattern", "strength"]
    if log_k is None:
        leaves = hits.groupBy("doc_key", *keys).agg(F.count("*").alias("n"))
        sets = [["doc_key", *(k for i, k in enumerate(keys) if kept >> i & 1)] for kept in range(8)]
        cells = leaves.groupingSets(sets, "doc_key", *keys).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
        report = cells.groupBy(*keys, "level").agg(F.sum("n").alias("n"), F.count("doc_key").alias("docs"))
    else:
        doc = F.when(F.col("doc_key").isNotNull(), F.xxhash64("doc_key"))  # a sketch leaves empty strings out
        leaves = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(doc, log_k).alias("docs"))
        docs = F.hll_sketch_estimate(F.hll_union_agg("docs"))
        report = leaves.cube(*keys).agg(F.sum("n").alias("n"), docs.alias("docs"), F.grouping_id().alias("level"))
    return report.select(*keys, "n", "docs", F.col("level").cast("long").alias("level"))


def coverage_report(states: DataFrame) -> DataFrame:
    """states (page_id, sticker_id, state) to counts and the first lost id of each page."""
    lost = F.col("state") == "lost"
    return states.groupBy("page_id").agg(
        F.count_if(lost).alias("lost"), F.count_if(F.col("state") == "attached").alias("attached"), F.count_if(F.col("state") == "backstop").alias("backstop"),
        F.min(F.when(lost, F.col("sticker_id"))).alias("first_lost"),
    )


def token_set(tokens: DataFrame, keys: list[str], most: int = 32) -> DataFrame:
    """tokens (keys…, place, hmac) to the first distinct identities of each key, in order."""
    once = tokens.groupBy(*keys, "hmac").agg(F.min("place").alias("place"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    kept = once.withColumn("n", n).where(F.col("n") <= most)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "hmac"))), lambda x: x["hmac"]).alias("hmacs"))


def clean_detectors(rows: DataFrame, scope: str) -> DataFrame:
    """Detector rows (list_id, place, id, …): fields checked and bounded, the first of equal ids, the newest 50 of a list."""
    good = rows.where(F.col("id").rlike(r"^[A-Za-z0-9_-]{1,64}\z") & F.length("regex").between(1, 200))
    n = F.row_number().over(Window.partitionBy("list_id", "id").orderBy("place"))
    good = good.withColumn("n", n).where("n = 1")
    label = lambda s: F.substring(F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}]+", " ")), 1, 40)
    name = F.substring(F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), f"[{WS}]+", " ")), 1, 40)
    labels = F.slice(F.filter(F.transform(F.coalesce("labels", F.array().cast("array<string>")), label), lambda s: s != ""), F.lit(1), F.lit(8))
    cleaned = good.select(
        "list_id", "place", "id", F.when(name == "", "Custom pattern").otherwise(name).alias("name"),
        F.when(F.col("source").isin("catalog", "template", "regex"), F.col("source")).otherwise("example").alias("source"), "regex",
        F.when(F.col("flags").rlike(r"^[iu]{0,2}\z"), F.col("flags")).alias("flags"), labels.alias("labels"),
        F.when(F.col("strength").isin("high", "medium"), F.col("strength")).otherwise("low").alias("strength"), F.lit(scope).alias("scope"),
        (F.col("origin") if scope == "site" else F.lit(None).cast("string")).alias("origin"), F.coalesce("createdAt", F.lit(0)).alias("createdAt"),
    )
    newest = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("place")))
    return cleaned.withColumn("n", newest).where("n <= 50").drop("n")


def clean_toggles(toggles: Column) -> Column:
    return F.map_filter(toggles, lambda k, v: k.rlike(r"^[a-z0-9-]{1,40}\z") & v.isNotNull())
