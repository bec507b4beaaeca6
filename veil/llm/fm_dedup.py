"""Operator 2: removal of word windows that occur anywhere else, by an FM-index per shard.

Every word that a window of ``size`` consecutive words covers is removed if the window's words also
start at any other place, in the same document or another.  Each shard's text is held in a compressed
FM-index; the windows of the documents dealt to it are streamed through backward search, which
gives matching statistics, and those that reach the window size with two or more occurrences are
reported as intervals.

Cases: null text has no words; documents of under ``size`` words keep everything; rows that share a
doc_id (or have none) are separate documents; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W
from .common import flat, keyed, ranges_to_mask, table
from .fm_index import FMIndex
from .repeats import repeats, spans, word_bounds, word_symbols

SIZE = 35
GRAM = 8
#: Files that a group too large for a shard is dealt to, by a second minimizer.
FILES = 64

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _index(size: int):
    def run(key, start, runs, contents):
        names: dict[bytes, int] = {}
        text, lengths = [], []
        for content in contents:
            words = content.split(b" ")
            text += [names.setdefault(w, len(names) + 2) for w in words]
            text.append(1)
            lengths.append(len(words) + 1)
        fm = FMIndex(np.array([*text, 0], np.int64))
        runs = np.array(runs, np.int64)
        base = np.cumsum(lengths) - lengths
        step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        ends = np.repeat(base, runs) + step + size
        again = fm.matching(ends, size) >= size
        return spans(np.repeat(np.array(key, np.int64), runs)[again], (np.repeat(np.array(start, np.int64), runs) + step)[again])

    return run


def _large(size: int, gram: int):
    """A group above the shard size is cut anew by longer grams and dealt to files, each its own shard."""
    index = _index(size)

    def run(chunks):
        with tempfile.TemporaryDirectory() as folder:
            paths = [os.path.join(folder, str(i)) for i in range(FILES)]
            for key, start, runs, contents in chunks:
                data = np.frombuffer(b" ".join(contents), np.uint8)
                length = np.array([len(c) for c in contents], np.int64)
                e = np.cumsum(length + 1) - 1
                a, b, first, last = word_bounds(data, e - length, e)
                doc, at, n, m, _ = W.super_windows(word_symbols(data, a, b), first, last, size, gram)
                rows: dict[int, list] = {}
                split = [c.split(b" ") for c in contents]
                for d, p, r, f in zip(doc.tolist(), at.tolist(), n.tolist(), (m % FILES).tolist(), strict=True):
                    rows.setdefault(f, []).append((key[d], start[d] + p, r, b" ".join(split[d][p : p + r + size - 1])))
                for f, some in rows.items():
                    with open(paths[f], "ab") as out:
                        pickle.dump(some, out)
            for path in filter(os.path.exists, paths):
                rows = []
                with open(path, "rb") as f:
                    while f.peek(1):
                        rows += pickle.load(f)
                yield index(*zip(*rows, strict=True))

    return run


def _apply(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = flat(batch.column("text"))
            listed = batch.column("spans")
            offsets = np.asarray(listed.offsets)
            start, runs = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "runs"))
            n_words, n_removed, shas, texts = [], [], [], []
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                words = data[a:b].tobytes().split()
                s, r = start[offsets[i] : offsets[i + 1]], runs[offsets[i] : offsets[i + 1]]
                n_words.append(len(words))
                if len(s):
                    gone = ranges_to_mask(len(words), s, s + r + size - 1)
                    words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [batch.column("key"), *columns, pa.array(texts, pa.string())], ["key", *names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def fm_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """The counts and digest of RESULT per document; with_text adds its key and the kept words."""
    if not 0 < gram <= size:
        raise ValueError("grams must fit into windows")
    base = keyed(docs).select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = repeats(base, "word", size, gram, True, _index(size), _large(size, min(size, gram + 4)))
    schema = f"key long, {RESULT}, kept string" if with_text else RESULT
    return found.mapInArrow(_apply(size, with_text), schema)


def op2_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup(table(spark, sf_dir, "documents"))
