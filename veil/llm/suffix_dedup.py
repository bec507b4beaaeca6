"""Operator 3: exact substring dedup by suffix sorting.

Every byte that lies in a ``size``-byte string which also starts earlier (a smaller document, or
the same document before) is removed.  Strings are judged on the input.  A shard's text is sorted by
induced sorting (suffix.py): leftmost-S substrings are named, their string is sorted by recursion,
and the order of all suffixes is induced from it; the common prefix of neighbours is then compared.
A group too large for a shard is sorted by external induction: disk-backed priority queues carry suffix tuples
with common-prefix values through the recursion (external.py).

Cases: null text counts as empty; documents shorter than ``size`` keep everything; rows that share a
doc_id (or have none) are separate documents in order of doc_id (nulls first), then text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, keyed, keyed_rows, ranges_to_mask, table
from .repeats import repeats, spans
from .suffix import first_windows, first_windows_external

SIZE = 100
#: Least hash of 44-byte grams: with shorter ones common word pairs pass for possible repeats.
GRAM = 44

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _layout(key, start, runs, contents, size):
    """The contents laid end to end: bytes, place of each window, its document and place there."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    runs = np.array(runs, np.int64)
    length = np.array([len(c) for c in contents], np.int64)
    base = np.cumsum(length) - length
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return data, np.repeat(base, runs) + step, np.repeat(np.array(key, np.int64), runs), np.repeat(np.array(start, np.int64), runs) + step


def _index(size: int):
    def run(key, start, runs, contents):
        data, at, keys, places = _layout(key, start, runs, contents, size)
        order = np.empty(len(at), np.int64)
        order[np.lexsort((places, keys))] = np.arange(len(at))
        later = first_windows(data, at, order, size)
        return spans(keys[later], places[later])

    return run


def _large(size: int):
    """A group above the shard size, sorted by external induction."""

    def run(chunks):
        found_keys, found_places = [], []

        def runs_on_disk():
            for key, start, runs, contents in chunks:
                yield _layout(key, start, runs, contents, size)

        for k, p in first_windows_external(runs_on_disk(), size):
            found_keys.append(k)
            found_places.append(p)
            if len(found_keys) == 1 << 16:
                yield spans(np.array(found_keys), np.array(found_places))
                found_keys, found_places = [], []
        yield spans(np.array(found_keys, np.int64), np.array(found_places, np.int64))

    return run


def _apply(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = flat(batch.column("text"))
            listed = batch.column("spans")
            offsets = np.asarray(listed.offsets)
            start, runs = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "runs"))
            n_removed, n_spans, shas, texts = [], [], [], []
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                whole = data[a:b]
                s, r = start[offsets[i] : offsets[i + 1]], runs[offsets[i] : offsets[i + 1]]
                if len(s):
                    gone = ranges_to_mask(b - a, s, s + r + size - 1)
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    whole = whole[~gone]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                kept = whole.tobytes()
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            columns = [batch.column("doc_id"), pa.array(ends - starts), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [batch.column("key"), *columns, pa.array(texts, pa.string())], ["key", *names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The counts and digest of RESULT per document."""
    return dedup_keyed(keyed(docs), size, gram)


def dedup_keyed(keyed_docs: DataFrame, size: int = SIZE, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """suffix_dedup of documents that have a key; with_text adds key and kept text.

    A cut inside a UTF-8 sequence leaves bytes that are not text: the digest has them, ``kept`` drops them.
    """
    if size < 16:
        raise ValueError("windows of under 16 bytes repeat everywhere")
    base = keyed_docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = repeats(base, "byte", size, gram, False, _index(size), _large(size))
    schema = f"key long, {RESULT}, kept string" if with_text else RESULT
    return found.mapInArrow(_apply(size, with_text), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut from text, and n_chars, where it is there, of what is left."""
    base = keyed_rows(docs)
    kept = dedup_keyed(base, with_text=True).select("key", "kept")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return base.select("key", "row").join(kept, "key").select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
