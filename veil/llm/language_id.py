"""Operator 9: language ID of mixed-language text.

Each word has a script, by the range of its first letter; the languages that were seen in that script
are its candidates.  A word's score for each candidate is the log-probability of its character
trigrams (hashed to ``buckets`` classes).  A Viterbi pass over the words, in which a switch of language
costs ``switch``, labels each word; neighbours with one label are a span.  The document's language is the
label with the most letters, its score that label's share of the letters.  Its gain is how much better the
words' best languages predict its trigrams than a model that knows nothing (nats a trigram, all classes alike):
text of no learned language has a gain below 0.

Learning counts trigrams and scripts over all training rows; only the counts, languages times a fixed
number of classes, come to the driver.

Cases: null texts and texts without a letter are ``und`` with score 0; rows are labelled one by one, so
repeated rows and missing ids need no rule; rows without lang teach nothing; if nothing was learned
every document is ``und``; very long texts are walked whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .windows import mix

UNKNOWN = "und"
BUCKETS = 1 << 14
SWITCH = 8.0
SMOOTH = 0.5
#: A language is a candidate in a script that has this share of its letters.
SHARE = 0.01
#: Languages that can be learned; a table with more is refused, as the model is held in memory.
LANGUAGES = 1000
#: Words walked at once: documents side by side times the words of the longest.
MATRIX = 1 << 19
ROWS = 256

# First code points of script ranges (Unicode block starts), fixed values.
_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({name for _, name in _RANGES})
_STARTS = np.array([start for start, _ in _RANGES])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in _RANGES])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """Distinct words of a batch: trigram classes, letters and script of each."""

    def __init__(self, words: list[bytes], buckets: int):
        joined = b" " + b" ".join(words) + b" "
        points = np.frombuffer(joined.decode().lower().encode("utf-32-le"), np.uint32)
        letter = _letters()[np.minimum(points, 0x10FFFF)]
        gap = np.flatnonzero(points == 32)
        self.starts = gap[:-1]
        p = points.astype(np.uint64)
        with np.errstate(over="ignore"):
            three = p[:-2] + (p[1:-1] << np.uint64(21)) + (p[2:] << np.uint64(42))
            self.classes = (mix(three) % np.uint64(buckets)).astype(np.int64)
        self.count = np.diff(gap) - 1  # trigrams of each word: one for each character
        self.letters = np.add.reduceat(letter.astype(np.int64), gap[:-1])
        first = np.where(letter, np.arange(len(points)), len(points))
        first = np.minimum.reduceat(first, gap[:-1])
        at = points[np.minimum(first, len(points) - 1)]
        self.scripts = _SCRIPT_OF[np.searchsorted(_STARTS, at, side="right") - 1]

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, class) of every trigram; a word's trigrams begin at the space before it."""
        word = np.repeat(np.arange(len(self.count)), self.count)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return word, self.classes[self.starts[word] + place]


def _batch(rows: pa.RecordBatch) -> tuple[list[list[bytes]], dict[bytes, int]]:
    split = [text.split() for text in rows.column("text").to_pylist()]
    names: dict[bytes, int] = {}
    for words in split:
        for word in words:
            if word not in names:
                names[word] = len(names)
    return split, names


def _learn(buckets: int):
    width = buckets + len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                split, names = _batch(rows)
                if not names:
                    continue
                known = Words(list(names), buckets)
                word, classes = known.trigrams()
                langs = rows.column("lang").to_pylist()
                for lang in set(langs):
                    ids = [names[w] for words, own in zip(split, langs, strict=True) if own == lang for w in words]
                    times = np.bincount(np.array(ids, np.int64), minlength=len(names)) * (known.letters > 0)
                    total = totals.setdefault(lang, np.zeros(width))
                    total[:buckets] += np.bincount(classes, times[word], buckets)
                    total[buckets:] += np.bincount(known.scripts, times * known.letters, len(SCRIPTS))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))], ["lang", "class", "n"])

    return run


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, buckets: int, smooth: float):
        self.langs, self.buckets = langs, buckets
        grams, scripts = counts[:, :buckets], counts[:, buckets:]
        self.logs = (np.log(grams + smooth) - np.log(grams.sum(1, keepdims=True) + smooth * buckets)).T.astype(np.float32)
        allowed = scripts >= np.maximum(1, SHARE * scripts.sum(1, keepdims=True))
        allowed[:, ~allowed.any(0)] = True  # a script of no language leaves all of them
        self.barred = np.where(allowed, 0, -1e4).T.astype(np.float32)

    def scores(self, known: Words) -> np.ndarray:
        """Log-probability of each word under each language, at most 1000 below its best candidate's."""
        return self.scores_and_gains(known)[0]

    def scores_and_gains(self, known: Words) -> tuple[np.ndarray, np.ndarray]:
        """scores, and each word's best log-probability above that of as many trigrams of equal chance."""
        word, classes = known.trigrams()
        begin = np.cumsum(known.count) - known.count
        out = np.add.reduceat(self.logs[classes], begin, axis=0) + self.barred[known.scripts]
        best = out.max(1, keepdims=True)
        lettered = known.letters > 0
        return np.maximum(out - best, -1e3) * lettered[:, None], (best[:, 0] + known.count * np.log(self.buckets)) * lettered


def fit(train: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> Model:
    """train: (text, lang); all of its rows are counted."""
    small_batches(train.sparkSession)
    rows = train.where("lang is not null and text is not null").select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_learn(buckets), "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table_ = np.zeros((len(langs), buckets + len(SCRIPTS)))
    number = {lang: i for i, lang in enumerate(langs)}
    table_[[number[x] for x in found.column("lang").to_pylist()], found.column("class").to_numpy()] = found.column("n").to_numpy()
    return Model(langs, table_, buckets, smooth)


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """For each document (words x languages) the best label of each word; documents are walked side by side."""
    out: list = [np.zeros(0, np.int64)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
    while order:
        group = order[-max(1, MATRIX // len(scores[order[-1]])) :]
        del order[-len(group) :]
        n = np.array([len(scores[i]) for i in group])
        most, langs = int(n.max()), scores[group[0]].shape[1]
        local = np.zeros((most, len(group), langs), np.float32)
        for k, i in enumerate(group):
            local[: n[k], k] = scores[i]
        best = np.empty((most, len(group)), np.int16)
        moved = np.empty((most, len(group), langs), bool)
        value = local[0].copy()
        for t in range(1, most):
            top = value.argmax(1)
            jump = value.max(1, keepdims=True) - np.float32(switch)
            best[t] = top
            np.less(value, jump, out=moved[t])
            value = np.maximum(value, jump)
            value += local[t]
        label = value.argmax(1)  # past a document's end all scores are 0, so its last label stays best
        rows = np.arange(len(group))
        labels = np.empty((most, len(group)), np.int16)
        for t in range(most - 1, 0, -1):
            labels[t] = label
            label = np.where(moved[t, rows, label], best[t], label)
        labels[0] = label
        for k, i in enumerate(group):
            out[i] = labels[: n[k], k]
    return out


def _predict(model: Model, switch: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                split, names = _batch(rows)
                langs, shares, gains, spans = [], [], [], []
                if names and model.langs:
                    known = Words(list(names), model.buckets)
                    word_scores, word_gains = model.scores_and_gains(known)
                    counts = known.count * (known.letters > 0)
                    ids = [np.fromiter(map(names.__getitem__, words), np.int64, len(words)) for words in split]
                    labelled = viterbi([word_scores[i] for i in ids], switch)
                    letters = [known.letters[i] for i in ids]
                    gains = [float(word_gains[i].sum() / max(1, counts[i].sum())) for i in ids]
                else:
                    labelled = letters = [np.zeros(0, np.int64)] * len(split)
                    gains = [0.0] * len(split)
                for labels, own in zip(labelled, letters, strict=True):
                    by_lang = np.bincount(labels, own, len(model.langs))
                    total = own.sum()
                    langs.append(model.langs[int(by_lang.argmax())] if total else UNKNOWN)
                    shares.append(float(by_lang.max() / total) if total else 0.0)
                    if with_spans:
                        new = np.flatnonzero(np.append(True, labels[1:] != labels[:-1])) if len(labels) else np.zeros(0, int)
                        stops = np.append(new[1:], len(labels))
                        spans.append([{"lang": model.langs[labels[a]], "start": int(a), "stop": int(b)} for a, b in zip(new, stops, strict=True)] if total else [])
                columns = [rows.column(c) for c in rows.schema.names if c != "text"] + [pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(gains, pa.float64())]
                names_ = [c for c in rows.schema.names if c != "text"] + ["lang_pred", "score", "gain"]
                if with_spans:
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
                    columns, names_ = [*columns, pa.array(spans, kind)], [*names_, "spans"]
                yield pa.RecordBatch.from_arrays(columns, names_)

    return run


def language_spans(docs: DataFrame, model: Model, keep: list[str], switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """The columns ``keep`` of docs (not ``text``), lang_pred, score, gain and spans (lang, first word, word after the last)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(*keep, text.alias("text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType())])
    if with_spans:
        span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
        schema.add("spans", T.ArrayType(span))
    return base.mapInArrow(_predict(model, switch, with_spans), schema)


def keep_identified(docs: DataFrame, least: float = 0.5, gain: float = 0.0) -> DataFrame:
    """Documents in a learned language: not ``und``, with a score of ``least``, and better predicted by the learned
    languages than by a model that knows nothing (``gain``). Learned from all documents that have a lang."""
    model = fit(docs.select("text", "lang"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = language_spans(rows, model, ["row"], with_spans=False)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & (F.col("gain") >= gain)).select("row.*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(docs.where("not held_out").select("text", "lang"))
    return language_spans(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"], with_spans=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
