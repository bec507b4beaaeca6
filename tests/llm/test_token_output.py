"""Token files against plain arrays, ids against the library on whole texts, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veil.llm import token_output as T
from veil.llm import wavelet


def random_text(rng, n):
    bits = [" ", " ", "\n", "\t", "  ", " \n", "\r\n", " ", "\x1c", " ", "'s", "'", "don't", "foo", "Été", "BAR", "x", "12", "½", "²", ",", ".", "(", "...", "<|endoftext|>", "<|", "日本", "😀", "ß", "_", "×"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_ids_as_the_library_says():
    rng, path = random.Random(1), T.tokenizer_path()
    library, ids = Tokenizer.from_file(path), T.PieceIds(path)
    texts = [random_text(rng, rng.randint(0, 40)) for _ in range(4000)] + ["plain words, and (others).\nA line's end", "", " ", "\n", "\n\n", " a", "a "]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for a in range(0, len(texts), 400):
        found = ids(texts[a : a + 400])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == want[a : a + 400]


class Asked:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, texts, **how):
        self.n += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **how)


def test_a_full_table_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(T, "KEEP_PIECES", 100, raising=False)
    monkeypatch.setattr(T, "KEEP_PARTS", 100)
    ids = T.PieceIds(T.tokenizer_path())
    texts = ["often used words, été (here)\nand there " + " ".join(chr(97 + i % 26) * (i // 26 + 1) for i in range(a, a + 300)) for a in (0, 300)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(T.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert [ids([t])[0] for t in texts] == want
    counts = [Asked(found) for found in (ids.tokenizer, getattr(ids, "model", None))]
    ids.tokenizer, ids.model = counts
    assert [ids([texts[1]])[0] for _ in range(3)] == want[1:] * 3
    assert sum(c.n for c in counts) == 0


def test_parts_of_latin_letters_as_the_library_says(monkeypatch):
    monkeypatch.setattr(T, "KEEP_PARTS", 50)
    rng, path = random.Random(2), T.tokenizer_path()
    letters = [*map(chr, range(192, 256)), *"aeionstrAEß_ÿĀªºµ"]
    texts = [" ".join(rng.choice(["", "", "(", "\"", "_"]) + "".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", ",", "...", "\n", "\x00", "'s", "<|endoftext|>"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    want, ids = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)], T.PieceIds(path)
    for a in range(0, len(texts), 250):
        assert [np.frombuffer(f, "<u4").tolist() for f in ids(texts[a : a + 250])] == want[a : a + 250]


def test_other_vocabularies_read_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = T.PieceIds(path)
    assert not ids.by_pieces
    text = "Some words,  and\nothers"
    assert np.frombuffer(ids([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, kinds, block", [(1, 1, 1 << 16), (700, 1, 64), (5000, 37, 256), (3000, 1025, 64), (20_000, 70_000, 1024)])
def test_file(monkeypatch, n, kinds, block):
    monkeypatch.setattr(wavelet, "BLOCK", block)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32) * 3 if kinds < 70_000 else rng.permutation(kinds)[:n].astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, n + 1, 5), n))
    docs = [None, -3, *range(2, len(ends))][: len(ends)]
    file = wavelet.TokenFile(wavelet.encode(ids, docs, ends))
    assert file.ids().tolist() == ids.tolist() and file.ends.tolist() == ends.tolist() and file.doc_ids == docs
    places = rng.integers(0, n, 40).tolist()
    assert [file.access(p) for p in places] == ids[places].tolist()
    for token in {*ids[places[:8]].tolist(), 1}:
        at = np.flatnonzero(ids == token)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert file.count(token) == len(at) and file.count(token, a, b) == ((at >= a) & (at < b)).sum()
        assert file.occurrences(token).tolist() == at.tolist()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert file.select(token, k) == at[k]
        with pytest.raises(IndexError):
            file.select(token, len(at))


def test_zipf_ids_are_compressed():
    ids = np.minimum(np.random.default_rng(3).zipf(1.2, 300_000), 50_000).astype(np.uint32)
    assert len(wavelet.encode(ids, [1], np.array([len(ids)]))) < 0.75 * 2 * len(ids)


def plain(rows):
    library, out, at = Tokenizer.from_file(T.tokenizer_path()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_op12(spark, odd):
    rng = random.Random(5)
    rows = [(i * 7 % 101 - 20, random_text(rng, rng.randint(0, 60))) for i in range(101)]
    if odd:
        rows += [(None, "b"), (None, "a"), (3, None), (3, ""), (3, "same"), (3, "same"), (400, "é" * 30_000 + " end")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, start long, content string").repartition(3)
    files = T.write_tokens(docs, shard_tokens=500)
    found = sorted((tuple(r) for r in T.read_tokens(files).collect()), key=lambda r: r[1])
    assert found == plain(rows)
    assert files.count() > 5
    # occurrences and counts of the first ids of some text, from the files
    ids = T.PieceIds.of(T.tokenizer_path())(["foo ("])[0]
    token = int(np.frombuffer(ids, "<u4")[0])
    library = Tokenizer.from_file(T.tokenizer_path())
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, at + i, i) for i, x in enumerate(own) if x == token]
        at += len(own)
    assert sorted((tuple(r) for r in T.occurrences(files, token).collect()), key=lambda r: r[1]) == want
    counts = {r.token: r.n for r in T.count_tokens(files, [token, 0, 50_255]).collect()}
    assert counts[token] == len(want) and counts[0] >= len(rows)


@pytest.mark.parametrize("chunk, most", [(1, 1), (1, 400), (1 << 30, 1), (1 << 30, 400), (2000, 1 << 20)])
def test_files_end_with_the_document_that_fills_them(monkeypatch, chunk, most):
    import pyarrow as pa

    monkeypatch.setattr(T, "CHUNK", chunk, raising=False)
    rng = random.Random(9)
    texts = [random_text(rng, rng.choice([0, 3, 90, 400])) for _ in range(60)]
    own = [[*e.ids, 0] for e in Tokenizer.from_file(T.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    batches = [pa.RecordBatch.from_pydict({"key": pa.array(range(a, a + 7), pa.int64())[: len(texts[a : a + 7])], "doc_id": pa.array([None] * len(texts[a : a + 7]), pa.int64()), "text": texts[a : a + 7]}) for a in range(0, 60, 7)]
    found, at, before = [b.to_pylist()[0] for b in T._write(T.tokenizer_path(), 0, most, iter(batches))], 0, 0
    for row in found:
        mine = own[at : at + row["n_docs"]]
        file = wavelet.TokenFile(row["content"])
        assert file.ids().tolist() == [x for d in mine for x in d] and file.doc_ids == [None] * len(mine)
        assert file.ends.tolist() == np.cumsum([len(d) for d in mine]).tolist()
        assert (row["first_key"], row["before"], row["n_tokens"]) == (at, before, file.n)
        assert file.n - len(mine[-1]) < most and (file.n >= most or row is found[-1])
        at, before = at + len(mine), before + file.n
    assert at == len(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(T.write_tokens(docs)).collect() == []
