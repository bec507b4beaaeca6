"""Operator 12: token ids as wavelet matrices, one compressed file for each shard.

Documents are dealt to ranges of their order; each task tokenises its range and writes files (wavelet.py) of about SHARD_TOKENS
ids, whole documents each, as rows of a table: Spark's writer commits them, so a task that is lost or run twice leaves one copy.
A row is (part, first_key, before, n_docs, n_tokens, content); ``before`` counts the ids of its part before the file, so where a
document starts in the whole corpus follows from one sum for each part.

A vocabulary that splits at white space without any normalising (its file says so) gives ids by pieces: text is cut at
single spaces and line ends between other characters, where such a vocabulary always begins a new pre-token.  The distinct
pieces of some megabytes of text are cut into parts; parts are looked up in a bounded table that a worker keeps, and only new
ones go to the library, many to a call.  A part of Latin letters or of punctuation is one pre-token, so it goes to the file's model at once.
Texts with control strings of the vocabulary or with CUT, and vocabularies of other kinds, go to the library whole.

Cases: null and empty texts are one end id; rows that share a doc_id are separate documents, in the order of text; a
null doc_id comes first; a document longer than a shard is one file; an empty table gives no files and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed, parts, small_batches, table
from .wavelet import TokenFile, encode

END_ID = 0
#: Ids of one file, about.
SHARD_TOKENS = 1 << 20
#: Parts of pieces that a worker keeps.
KEEP_PARTS = 500_000
#: Bytes of the texts that a worker takes together, about.
CHUNK = 8 << 20
_WORKER: dict = {}

FILES = "part int, first_key long, before long, n_docs long, n_tokens long, content binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"

_LINE, _SPACE = re.compile(r"(?<=\S)\n(?=\S)"), re.compile(r"(?<=\S) (?=\S)")
#: Where a text is cut; texts that hold this character go to the library whole.
CUT = "\x00"
#: The letter of byte 255, which is in no text: it ends a pre-token that goes to the model.
MARK = "ÿ"

# Latin letters between ASCII punctuation; an apostrophe may begin a suffix, so it is out.
_PUNCTUATION = r"[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
_PARTS = f"\\A(?P<a>\n?)(?P<b> ?{_PUNCTUATION}+)?(?P<c> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<d>{_PUNCTUATION}*)\\z"
_EMPTY = pa.scalar("", pa.large_string())


def tokenizer_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return str(path)


class PieceIds:
    """Ids of texts by a tokenizer's file, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        before = said.get("pre_tokenizer") or {}
        self.by_pieces = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        self.control = [t["content"] for t in said.get("added_tokens") or []]
        self.line = self._ids(["\n"])[0]
        self.by_pieces = self.by_pieces and len(self.line) == 1
        self.model = self._split_before(said["model"]) if self.by_pieces else None
        # parts with ids: their texts, all ids one after the other, how many each has
        self.kept = pa.array(["", "\n"], pa.large_string()), np.array(self.line, "<u4"), np.array([0, len(self.line)])

    @classmethod
    def of(cls, path: str) -> PieceIds:
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split_before(self, said: dict):
        """The file's model behind a split at line ends, for pre-tokens in the letters of bytes; none where it may join MARK to others."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = said.get("type") == "BPE" and not any(said.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or [t for t in said["vocab"] if MARK in t] != [MARK]:
            return None
        self.mark = said["vocab"][MARK]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(ord("À"), 256)}
        found = Tokenizer(self.tokenizer.model)
        found.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.flat(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        column = column.cast(pa.large_string())
        plain, odd, whole, pieces, given = [], [], [], [], []
        for i, text in enumerate(column.to_pylist()):
            if not self.by_pieces or CUT in text or any(c in text for c in self.control):
                whole.append(i)
                given += self._ids([text])
            elif _odd(text):
                odd.append(i)
                pieces.append(_pieces(text))
            else:
                plain.append(i)
        some = column if len(plain) == len(column) else column.take(pa.array(plain, pa.int64()))
        for c in " \n":
            some = pc.replace_substring(some, c, CUT + c)
        split = pc.split_pattern(some, CUT)
        distinct = pa.concat_arrays([split.flatten(), _strings(x for p in pieces for x in p)]).dictionary_encode()
        sizes = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(p) for p in pieces], np.int64), np.ones(len(whole), np.int64)])
        del column, some, split, pieces  # they are as large as the texts
        ids, lengths = self._of_pieces(distinct.dictionary)
        codes = distinct.indices.to_numpy()
        if odd or whole:
            # a whole text is one piece by itself
            place, codes = np.argsort(plain + odd + whole), np.concatenate([codes, len(lengths) + np.arange(len(whole))])
            codes, sizes = _gather(codes, sizes, place), sizes[place]
            ids = np.concatenate([ids, *(np.array(g, "<u4") for g in given)])
            lengths = np.concatenate([lengths, np.array([len(g) for g in given], np.int64)])
        return _gather(ids, lengths, codes), np.add.reduceat(lengths[codes], np.cumsum(sizes) - sizes) if len(sizes) else sizes

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct pieces, from those of their parts, of which only new ones go to the library."""
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        parts = pc.extract_regex(pieces, _PARTS)
        columns = [pc.coalesce(c, pieces if i == 2 else _EMPTY) for i, c in enumerate(parts.flatten())]
        kept, ids, lengths = self.kept
        found = pa.concat_arrays([kept, *columns]).dictionary_encode()
        texts, codes = found.dictionary, found.indices.to_numpy()[len(kept) :]
        each, single = codes.reshape(4, len(pieces)), np.zeros(len(texts), bool)
        single[each[:, parts.is_valid().to_numpy(zero_copy_only=False)]] = True
        more, their = self._look_up(texts[len(kept) :], single[len(kept) :])
        ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, their])
        out = _gather(ids, lengths, each.T.ravel()), lengths[each].sum(0)
        if len(texts) > KEEP_PARTS:
            stay = np.unique(np.concatenate([np.arange(2), codes]))
            texts, ids, lengths = texts.take(pa.array(stay)), _gather(ids, lengths, stay), lengths[stay]
        self.kept = texts, ids, lengths
        return out

    def _look_up(self, texts: pa.Array, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of each part by the library. single: which are one pre-token of ASCII or of Latin letters; they go to the model in the letters of their bytes."""
        single, ascii_ = single & (self.model is not None), pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        order, ids, lengths = [], [], []
        for mask in (single & ascii_, single & ~ascii_):
            which = np.flatnonzero(mask)
            if not len(which):
                continue
            lists = pa.ListArray.from_arrays(pa.array([*range(0, len(which), 4096), len(which)], pa.int32()), texts.take(pa.array(which)))
            lines = pc.binary_join(lists, pa.scalar("\n", pa.large_string())).to_pylist()
            marked = [(x if x.isascii() else x.translate(self.letters)).replace(" ", "Ġ").replace("\n", f"{MARK}\n") + MARK for x in lines]
            found = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(marked, add_special_tokens=False)])
            is_mark = found == self.mark
            stops = np.flatnonzero(is_mark)
            if len(stops) != len(which):
                single = single & ~mask
                continue
            order.append(which)
            ids.append(found[~is_mark])
            lengths.append(np.diff(stops, prepend=-1) - 1)
        order.append(np.flatnonzero(~single))
        rest = self._by_lines(texts.take(pa.array(order[-1])).to_pylist())
        ids += [np.array(r, "<u4") for r in rest]
        lengths.append(np.array([len(r) for r in rest], np.int64))
        place = np.argsort(np.concatenate(order))
        ids, lengths = np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate(lengths)
        return _gather(ids, lengths, place), lengths[place]

    def _by_lines(self, texts: list[str]) -> list[list[int]]:
        """Ids of each, in few calls where none has odd white space: a line each."""
        out: list[list[int]] = []
        for a in range(0, len(texts), 8192):
            some = texts[a : a + 8192]
            joined = "\n".join(some)
            odd = "\n\n" in joined or " \n" in joined or "\n  " in joined or joined[:1] == "\n" or joined[:2] == "  " or joined[-1:] in (" ", "\n")
            if not odd and joined.replace("\n", "").isprintable():
                ids = self._ids([joined])[0]
                stops = [i for i, x in enumerate(ids) if x == self.line[0]]
                if len(stops) == len(some) - 1:
                    out += [ids[a:b] for a, b in zip([0, *(s + 1 for s in stops)], [*stops, len(ids)], strict=True)]
                    continue
            out += self._ids(some)
        return out


def _strings(texts: Iterable[str]) -> pa.Array:
    return pa.array(list(texts), pa.large_string())


def _gather(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of values laid end to end by groups of these lengths, the groups ``codes``, one after the other."""
    starts, out = np.cumsum(lengths) - lengths, [values[:0]]
    for a in range(0, len(codes), 1 << 16):  # what is between stays in the processor's cache
        some = codes[a : a + (1 << 16)]
        each = lengths[some]
        ends = np.cumsum(each)
        out.append(values[np.repeat(starts[some] - ends + each, each) + np.arange(ends[-1])])
    return np.concatenate(out)


def _odd(text: str) -> bool:
    """Whether there is other white space than single spaces and line ends between other characters."""
    # what is printable has no white space but spaces
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or not text.replace("\n", "").isprintable()


def _pieces(text: str) -> list[str]:
    """The first piece, then those that begin at one space or one line end between other characters."""
    lines = [_SPACE.split(line) for line in _LINE.split(text)]
    return [f"{' ' if j else chr(10) if i else ''}{piece}" for i, line in enumerate(lines) for j, piece in enumerate(line)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about CHUNK bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _write(path: str, end_id: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, doc_id, text) in order: files."""
    from pyspark import TaskContext

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ids_of = PieceIds.of(path)
    context = TaskContext.get()
    part, before = context.partitionId() if context else 0, 0
    first, doc_ids, held, counts, size = None, [], [], [], 0
    kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())

    def done():
        content = encode(np.concatenate(held), doc_ids, np.cumsum(np.concatenate(counts)))
        row = (part, first, before, len(doc_ids), size, content)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in FILES.split(", ")])

    for batch in _chunks(batches):
        keys, theirs = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
        ids, each = ids_of.flat(batch.column("text"))
        ids, each = np.insert(ids, np.cumsum(each), end_id), each + 1
        ends, at = np.cumsum(each), 0
        while at < len(ends):
            begin = int(ends[at - 1]) if at else 0
            # up to the document that fills the file
            to = min(int(np.searchsorted(ends, begin + most - size)) + 1, len(ends))
            first = keys[at] if first is None else first
            doc_ids += theirs[at:to]
            held.append(ids[begin : ends[to - 1]])
            counts.append(each[at:to])
            size += int(ends[to - 1]) - begin
            at = to
            if size >= most:
                yield done()
                before += size
                first, doc_ids, held, counts, size = None, [], [], [], 0
    if doc_ids:
        yield done()


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Files of the ids of docs (doc_id, text) in order, as FILES, written in the shared folder."""
    small_batches(docs.sparkSession)
    given = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    in_order = given.repartitionByRange(parts(docs.sparkSession), "key").sortWithinPartitions("key")
    return cut(in_order.mapInArrow(partial(_write, tokenizer_path(path), end_id, shard_tokens), FILES))


def over_files(files: DataFrame, reader: Callable[[TokenFile], list[tuple]], schema: str) -> DataFrame:
    """What ``reader`` says of each file of files (content, start): rows whose last-but-``start`` columns are as in schema.

    start is the number of ids before the file; the reader's rows get it added to their second column.
    """
    kinds = [pa.int64()] * len(schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column("content"), batch.column("start").to_pylist(), strict=True):
                rows = reader(TokenFile(content.as_py()))
                if rows:
                    columns = [list(c) for c in zip(*rows, strict=True)]
                    columns[1] = [start + x for x in columns[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return files.select("content", "start").mapInArrow(run, schema)


def with_starts(files: DataFrame) -> DataFrame:
    """files with ``start``, the number of all ids before each: one sum for each part."""
    spark = files.sparkSession
    sums = sorted(files.groupBy("part").agg(F.min("first_key").alias("first"), F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["first"])
    starts, at = [], 0
    for r in sums:
        starts.append((r["part"], at))
        at += r["n"]
    return files.join(F.broadcast(spark.createDataFrame(starts, "part int, at long")), "part").withColumn("start", F.col("at") + F.col("before")).drop("at")


def _documents(file: TokenFile) -> list[tuple]:
    raw, ends = file.ids().astype("<u4").tobytes(), file.ends.tolist()
    view, begins = memoryview(raw), [0, *ends[:-1]]
    return [(d, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for d, a, b in zip(file.doc_ids, begins, ends, strict=True)]


def read_tokens(files: DataFrame) -> DataFrame:
    """Every document as the files have it, as RESULT."""
    return over_files(with_starts(files), _documents, RESULT)


def count_tokens(files: DataFrame, ids: list[int]) -> DataFrame:
    """(token, n): how often each id stands in all files, by rank, without decoding them."""
    each = over_files(with_starts(files), lambda f: [(i, 0, n) for i in ids if (n := f.count(i))], "token long, start long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, offset): where an id stands, in the corpus and in its document."""

    def found(file: TokenFile) -> list[tuple]:
        at = file.occurrences(token)
        which = np.searchsorted(file.ends, at, "right")
        begins = np.concatenate([[0], file.ends[:-1]])
        return [(file.doc_ids[w], p, p - int(begins[w])) for w, p in zip(which.tolist(), at.tolist(), strict=True)]

    return over_files(with_starts(files), found, "doc_id long, place long, offset long")


def op12_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
