"""Operator 4: packing token sequences by best-fit decreasing.

Documents are tokenised word by word where the tokenizer is known never to join text across white space
(``BY_WORDS``; any other one reads whole texts), each ends with one end id.  Documents longer than a window are first cut into full windows; what is left of
every document is a piece.  Pieces are dealt at random to bins' shards, and within a shard, longest
first, each goes to the open window with the least room that still holds it.  A segment tree over
remaining capacities finds that window.

Cases: null and empty texts are one end id; a row without doc_id packs like any other; repeated rows
are packed once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, small_batches, table

WINDOW = 2048
END_ID = 1
#: Digests of the files of vocabularies that split at white space and between letters and ASCII punctuation, and fold case: words have ids by themselves.
BY_WORDS = {"53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"}
#: Documents of one shard, on average; a shard leaves a few windows open.
SHARD_DOCS = 4096
#: Words that a worker keeps, and two thirds as many parts of words: about 340 bytes each, both together.
KEEP_WORDS = 1_200_000
_WORKER: dict = {}

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
RESULT = f"{_PIECE}, sequence_id long, offset long"


def tokenizer_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return str(path)


# Latin letters between ASCII punctuation; an apostrophe may begin a suffix and < a special token, so they are out.
_PUNCTUATION = r"[!\"#$%&()*+,\-./:;=?@\[\]^_`{|}~]*"
_PARTS = re.compile(f"({_PUNCTUATION})([A-Za-zÀ-ÖØ-öø-ÿ]+)({_PUNCTUATION})")


class WordIds:
    """Ids of distinct words, many to one call: words are set apart by a mark that is a token by itself.

    A Python worker keeps its words from task to task, in two tables of bounded size.
    """

    MARK = "\x01"

    def __init__(self, path: str, keep: int = KEEP_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, "rb") as file:
            self.by_words = hashlib.file_digest(file, "sha256").hexdigest() in BY_WORDS
        self.mark = self._ids([self.MARK])[0]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    @classmethod
    def of(cls, path: str, keep: int = KEEP_WORDS) -> WordIds:
        if (path, keep) not in _WORKER:
            _WORKER.clear()
            _WORKER[path, keep] = cls(path, keep)
        return _WORKER[path, keep]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: bytes) -> bytes:
        return np.array(self._ids([text.decode()])[0], "<u4").tobytes()

    def table(self, split: list[list[bytes]]) -> dict[bytes, bytes]:
        """The ids of all these words, and others."""
        if len(self.words) > self.keep:
            self.words = {}
        fresh = list(set().union(*split).difference(self.words))
        for a in range(0, len(fresh), 4096):
            some = fresh[a : a + 4096]
            self.words.update(zip(some, self(some), strict=True))
        return self.words

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """A word of letters between punctuation is three parts that the tokenizer never joins: parts are looked up once."""
        texts = [w.decode() for w in words]
        split = [m.groups() if m else None for m in map(_PARTS.fullmatch, texts)]
        if len(self.parts) > self.keep * 2 // 3:
            self.parts = {"": b""}
        parts = [(p[0], p[1].lower(), p[2]) if p else (t,) for p, t in zip(split, texts, strict=True)]
        fresh = list({p for word in parts for p in word}.difference(self.parts))
        known = self.parts
        known.update(zip(fresh, self._look_up(fresh), strict=True))
        return [known[w[0]] + known[w[1]] + known[w[2]] if len(w) == 3 else known[w[0]] for w in parts]

    def _look_up(self, texts: list[str]) -> list[bytes]:
        if len(self.mark) == 1 and texts and not any(self.MARK in t for t in texts):
            ids = np.array(self._ids([f" {self.MARK} ".join(texts)])[0], "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) == len(texts) - 1:
                raw = ids.tobytes()
                begin, end = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
                return [raw[a:b] for a, b in zip(begin, end, strict=True)]
        return [np.array(ids, "<u4").tobytes() for ids in self._ids(texts)]


def _tokenise(path: str, window: int, end_id: int, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    word_ids = WordIds.of(path, keep)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            raw = rows.column("text").to_pylist()
            if word_ids.by_words:
                split = [text.split() for text in raw]
                known = word_ids.table(split)
                given = (b"".join(map(known.__getitem__, words)) for words in split)
            else:
                given = (word_ids.whole(text) for text in raw)
            out: list[tuple] = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), given, strict=True):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    b = min(n, a + window)
                    out.append((doc_id, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), n))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


class OpenWindows:
    """Windows by remaining capacity, under a segment tree that says where any are."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.any = bytearray(2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.by_room[room].append(which)
        i, tree = room + self.leaves, self.any
        while i and not tree[i]:
            tree[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest window with room for ``length``: (room, window), taken out."""
        i, tree = length + self.leaves, self.any
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        which = self.by_room[room].pop()
        if not self.by_room[room]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return room, which


def _pack(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, count, windows = None, 0, OpenWindows(window)
    for batch in batches:
        sequence, offset = [], []
        for s, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if s != shard:
                shard, count, windows = s, 0, OpenWindows(window)
            found = windows.take(length)
            if found is None:
                room, which = window, count
                count += 1
            else:
                room, which = found
            sequence.append((s << 32) | which)
            offset.append(window - room)
            if room > length:
                windows.add(room - length, which)
        columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], RESULT.replace(" long", "").split(", "))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep: int = KEEP_WORDS) -> DataFrame:
    """The pieces of every document with their window and place in it, as RESULT. keep: words that a worker holds."""
    small_batches(docs.sparkSession)
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(partial(_tokenise, tokenizer_path(path), window, end_id, keep), _PIECE)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    # a task packs any number of shards one after the other
    ordered = dealt.repartition(parts(docs.sparkSession), "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")
    return ordered.mapInArrow(partial(_pack, window), RESULT)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
