"""Operator 1: token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the vocabulary's word mark before it.  The distinct pre-tokens of a batch
are walked in the order of their trie (sorted order is its depth-first order): the forward scores of
a prefix, the best log-probability of any segmentation up to each place and its number of tokens, are
computed once and shared by all pre-tokens that begin with it; each terminal stores its count.

The vocabulary is a public tokenizer's pieces; that file has merge ranks, which Zipf's law turns into
log-probabilities, -log(rank + ``shift``).  A character that no piece covers falls back to its UTF-8
bytes, one token each.

Cases: null and empty texts have no words and no tokens; rows are counted one by one, so repeated
rows and missing ids need no rule; very long texts are words like any; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
SHIFT = 10.0
#: Terminals that a task keeps between batches.
KEEP = 1_000_000
#: Rows whose words are held at once.
ROWS = 512


def vocabulary(path: str | None = None, shift: float = SHIFT) -> dict[str, float]:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + shift) for rank, i in enumerate(pieces)}


class Counter:
    """Token counts of pre-tokens; the trie path of the last one is all that is kept of the trie."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.byte_score = min(pieces.values()) - 10.0

    def counts(self, words: list[str]) -> dict[str, int]:
        """words: sorted and distinct."""
        get, longest, byte_score = self.pieces.get, self.longest, self.byte_score
        scores, tokens, last, out = [0.0], [0], "", {}
        for word in words:
            text = MARK + word
            shared, most = 0, min(len(last), len(text))
            while shared < most and last[shared] == text[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                # alone, the last character falls back to bytes
                n = len(text[end - 1].encode())
                best, count = scores[end - 1] + n * byte_score, tokens[end - 1] + n
                for begin in range(max(0, end - longest), end):
                    score = get(text[begin:end])
                    if score is not None and scores[begin] + score > best:
                        best, count = scores[begin] + score, tokens[begin] + 1
                scores.append(best)
                tokens.append(count)
            out[word] = tokens[-1]
            last = text
        return out


def _count(pieces: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                split = [text.split() for text in rows.column("text").to_pylist()]
                if len(known) > KEEP:
                    known = {}
                fresh = set().union(*split).difference(known)
                found = counter.counts(sorted(w.decode() for w in fresh))
                known.update((w.encode(), n) for w, n in found.items())
                n_tokens = [sum(map(known.__getitem__, words)) for words in split]
                columns = [rows.column("doc_id"), pa.array(list(map(len, split)), pa.int64()), pa.array(n_tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, shift: float = SHIFT) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row."""
    small_batches(docs.sparkSession)
    pieces = vocabulary(path, shift)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_count(pieces), "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
