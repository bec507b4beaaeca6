"""The training-data operators against plain versions, and their defined edge cases."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from veil.llm import chat_format, edit_embedding, external, fm_dedup, language_id, mixing, ngram_join, packing, quality_rules, repeats, suffix, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, taken string"


def corpus(seed=5, n=60):
    """Random prose with copies, near copies, shared passages, repeats, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ba", "ré", "ti", "on", "sk"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = prose(70)
    texts = []
    for i in range(n):
        w = prose(rng.randint(5, 160))
        if i % 4 == 0:
            w[3:3] = passage
        if i % 7 == 3 and texts:
            w = texts[-1].split()
        if i % 9 == 4 and texts:
            w = texts[rng.randrange(len(texts))].split()
            w[len(w) // 2] = "changed"
        texts.append((" " if i % 5 else "\n").join(w))
    texts += ["", "   \n", "one", "x y " * 120, "tok " * 500, "lone line\nlone line\n" * 4, texts[0] + "\t" + texts[0]]
    return texts


def docs_of(spark, texts):
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t or ""), "k", "r", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(None, None, None, None, None, None, None, None), (3, None, None, "a", None, "x", "y", "z"), (3, "same text here", "en", "a", 1, None, None, None), (3, "same text here", "en", None, 1, None, None, None), (None, "é" * 50_000 + " end", "fr", "b", 1, None, None, None)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).cache()


def test_suffix_array():
    rng = random.Random(1)
    for trial in range(120):
        n, k = rng.choice([70, 150, 400]), rng.choice([1, 2, 3, 250])
        text = [rng.randint(1, k) for _ in range(n)] + [0]
        if trial % 5 == 0:
            text = [1, 2, 3, 1, 1] * (n // 5) + [0]
        if trial % 7 == 0:
            text = sorted(text[:-1]) + [0]
        assert suffix.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("queue", [5, 1 << 17])
def test_external_induced_sorting(tmp_path, queue):
    """Order and common-prefix values, with queues that spill after five tuples."""
    rng = random.Random(1)
    for trial in range(120):
        n, k, most = rng.choice([1, 2, 5, 20, 60, 200]), rng.choice([1, 2, 3, 8, 200]), rng.choice([3, 10, 100])
        text = [rng.randint(1, k) for _ in range(n)] + [0]
        if trial % 5 == 0:
            text = ([1, 2, 3, 1, 1] * n)[:n] + [0]
        if trial % 7 == 0:
            text = sorted(text[:-1]) + [0]
        if trial % 11 == 0:
            text = text[:-1] * 3 + [0]
        (tmp_path / str(trial)).mkdir()
        found = list(external.Induced(text, str(tmp_path / str(trial)), most, queue).in_order())
        assert [p for p, _ in found] == sorted(range(len(text)), key=lambda i: text[i:])
        for (a, _), (b, common) in itertools.pairwise(found):
            assert common == min(most, len(os.path.commonprefix([text[a:], text[b:]])))


def test_op3_shards_on_disk(docs, texts, monkeypatch):
    """Every group goes through the external way: a shard is a few bytes and a queue holds 50 tuples."""
    monkeypatch.setattr(repeats, "SHARD", 64)
    want = {d: v[:4] for d, v in brute.strings_before(list(enumerate(texts))).items()}
    real = suffix_dedup.first_windows_external
    monkeypatch.setattr(suffix_dedup, "first_windows_external", lambda runs, size: real(runs, size, 50))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def _windows(found):
    return sorted((int(k), int(p)) for ks, ss, ns in found for k, s, n in zip(ks, ss, ns) for p in range(s, s + n))


@pytest.mark.parametrize("module, size", [(fm_dedup, 35), (suffix_dedup, 100)])
def test_group_above_a_shard(module, size):
    rng = random.Random(3)
    base = [rng.choice("abcdef") + str(rng.randint(0, 9)) for _ in range(300)]
    if module is fm_dedup:
        contents = [" ".join(base[p : p + rng.randint(35, 98)]).encode() for p in (rng.randint(0, 200) for _ in range(60))]
        runs = [c.count(b" ") + 1 - 34 for c in contents]
        large = module._large(size, 12)
    else:
        contents = [("".join(base)[p : p + rng.randint(100, 180)]).encode() for p in (rng.randint(0, 400) for _ in range(60))]
        runs = [len(c) - 99 for c in contents]
        large = module._large(size)
    rows = ([i - 30 for i in range(60)], [0] * 60, runs, contents)
    chunks = (tuple(x[a : a + 7] for x in rows) for a in range(0, 60, 7))
    assert _windows(large(chunks)) == _windows([module._index(size)(*rows)])


def test_op1_counts(spark, docs, texts):
    pieces = token_counts.vocabulary()
    counter = token_counts.Counter(pieces)

    def plain(word):
        text = token_counts.MARK + word
        best = [(0.0, 0)]
        for e in range(1, len(text) + 1):
            n = len(text[e - 1].encode())
            found = (best[e - 1][0] + n * counter.byte_score, best[e - 1][1] + n)
            for i in range(e):
                if text[i:e] in pieces and best[i][0] + pieces[text[i:e]] > found[0]:
                    found = (best[i][0] + pieces[text[i:e]], best[i][1] + 1)
            best.append(found)
        return best[-1][1]

    for r in token_counts.token_counts(docs).collect():
        w = texts[r.doc_id].split()
        assert (r.n_words, r.n_tokens) == (len(w), sum(map(plain, w)))


def test_op2_words(docs, texts):
    want = brute.windows_elsewhere(list(enumerate(texts)))
    assert {r.doc_id: tuple(r)[1:] for r in fm_dedup.fm_dedup(docs).collect()} == want
    assert sum(v[1] for v in want.values()) > 500


def test_op3_strings(docs, texts):
    want = {d: v[:4] for d, v in brute.strings_before(list(enumerate(texts))).items()}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()} == want
    assert sum(v[1] for v in want.values()) > 2000


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_windows_of_heavy_groups(docs, texts, monkeypatch, unit):
    monkeypatch.setitem(repeats.MOST, unit, 150)
    if unit == "word":
        found, want = fm_dedup.fm_dedup(docs), brute.windows_elsewhere(list(enumerate(texts)))
    else:
        found, want = suffix_dedup.suffix_dedup(docs), {d: v[:4] for d, v in brute.strings_before(list(enumerate(texts))).items()}
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


@pytest.mark.parametrize("module", [fm_dedup, suffix_dedup])
def test_hot_passage_in_many_surroundings(spark, monkeypatch, module):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(40 if module is fm_dedup else 24))
    around = 30 if module is fm_dedup else 14
    texts = [f"{' '.join(word() for _ in range(around))} {passage} {' '.join(word() for _ in range(around))}" for _ in range(3500 if module is fm_dedup else 8000)]

    most, real = (135_000 if module is fm_dedup else 800_000), module._large

    def bounded(size, *rest):
        inner = real(size, *rest)

        def run(chunks):
            chunks = list(chunks)
            assert sum(sum(c[2]) + len(c[2]) * (size - 1) for c in chunks) < most, "one group holds the text of every document"
            yield from inner(iter(chunks))

        return run

    monkeypatch.setattr(module, "_large", bounded)
    if module is fm_dedup:
        found, want = fm_dedup.fm_dedup(docs_of(spark, texts)), brute.windows_elsewhere(list(enumerate(texts)))
    else:
        found, want = suffix_dedup.suffix_dedup(docs_of(spark, texts)), {d: v[:4] for d, v in brute.strings_before(list(enumerate(texts))).items()}
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


def test_op3_rows_that_share_an_id(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(300))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (4, text + "zz")], "doc_id long, text string")
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(rows).collect()), reverse=True)
    assert found == [(True, 0, 300, 0), (False, 5, 300, 300), (False, 5, 300, 300), (False, 4, 302, 300)]


def test_op4_pieces(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    rows = packing.pack(docs, window=128).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in by_doc.items():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) == len(ids[d])
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(parts[-1]) <= 128
    assert sum(map(len, ids)) > 0.95 * 128 * len(by_sequence)


def test_best_fit():
    windows = packing.OpenWindows(100)
    for room in (40, 10, 70):
        windows.add(room, room)
    assert windows.take(11) == (40, 40) and windows.take(11) == (70, 70) and windows.take(11) is None and windows.take(10) == (10, 10)


@pytest.mark.parametrize("block, grams", [(512, 1 << 21), (2, 1 << 21), (512, 300)])
def test_op5_classes(docs, texts, monkeypatch, block, grams):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    found = {r.doc_id: (r.class_key, r.copy_key, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert found == brute.jaccard_classes(list(enumerate(texts)))


def test_op5_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(w))
    found = ngram_join.ngram_join(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.class_key, r.copy_key, r.n_links) for r in found} == brute.jaccard_classes(list(enumerate(texts)))


def test_op6_rules(spark, docs, texts):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(texts[r.doc_id])


def test_op6_score(spark):
    import math

    import xxhash

    texts = ["a b c d e f g h i j k", "a b c d e f g h i j z z2", "q r s t u v w x y z aa"]
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs_of(spark, texts), labels, buckets=64, threshold=0.0).collect()}

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in text.split()]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)) for a, b in itertools.pairwise(h)]
        return [signed(x) % 64 for x in h + pairs]

    raw, target = np.bincount([g for t in texts for g in grams(t)], minlength=64), np.bincount(grams(texts[0]), minlength=64)
    ratio = np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    for i, t in enumerate(texts):
        assert math.isclose(rows[i].score, ratio[grams(t)].mean(), rel_tol=1e-9) or abs(rows[i].score - ratio[grams(t)].mean()) < 1e-9
        assert rows[i].kept == (ratio[grams(t)].mean() >= 0)


def test_op7_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in edit_embedding.fingerprint_edits(docs).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert len({(rows[i].fingerprint, t) for i, t in enumerate(texts)}) == len(set(texts))
    far = [r for r in rows.values() if r.n_chars > 300 and r.near_next < 0.5]
    assert np.mean([r.near_edited for r in far]) > np.mean([r.near_next for r in far]) + 0.3


def plain_walk(text, limit):
    """The symbol at each of the first ``limit`` places of a text's embedding, one step at a time."""
    stay, points, out, step = edit_embedding.walk_table(), [ord(c) for c in text] + [0, 0], [], 0
    for i in range(len(text)):
        cls = int(edit_embedding.mix(np.array([points[i]], np.uint64))[0]) & (edit_embedding.CLASSES - 1)
        # the walker stays until a random bit of (class, step) lets it go
        n = int(stay[cls * edit_embedding.PERIOD + step % edit_embedding.PERIOD])
        three = (points[i] + (points[i + 1] << 21) + (points[i + 2] << 42)) % (1 << 64)
        out += [int(edit_embedding.mix(np.array([three], np.uint64))[0]) & 255] * n
        step += n
    return out[:limit], step


def plain_likeness(a, b):
    """Share of equal symbols over all sampled places up to the end of the longer embedding."""
    (xa, sa), (xb, sb) = plain_walk(a, 1 << 30), plain_walk(b, 1 << 30)
    if not sa or not sb:
        return float(sa == sb)
    level = max(0, (-(-max(sa, sb) // edit_embedding.SAMPLES) - 1).bit_length())
    places = edit_embedding.sampled_places(1 << max(sa, sb).bit_length())[level]
    places = places[places < max(sa, sb)]
    same = sum(int(p) < min(sa, sb) and xa[p] == xb[p] for p in places)
    return same / len(places) if len(places) else float(a == b)


def test_op7_plain_walker():
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdé fgh") for _ in range(n)) for n in (0, 1, 2, 30, 200, 700)]
    texts += [t[: len(t) // 2] + "X" + t[len(t) // 2 :] for t in texts]
    embedding = edit_embedding.Embedding()
    found = embedding.fingerprints([edit_embedding._points(t) for t in texts])
    want = np.array([[plain_likeness(a, b) for b in texts] for a in texts])
    got = np.array([[embedding.likeness(a, b) for b in found] for a in found])
    assert np.allclose(got, want) and np.allclose(edit_embedding.likenesses(embedding, found), want)


@pytest.mark.parametrize("block", [512, 3])
def test_op7_near_classes(spark, monkeypatch, block):
    """Chains of near texts (A near B, B near C, A not near C) are one class; brute force over all pairs agrees."""
    monkeypatch.setattr(edit_embedding, "BLOCK", block)
    rng = random.Random(6)
    texts = []
    for n in (90, 260, 900, 4000):
        for _ in range(4):
            t = "".join(rng.choice("abcdefgh ") for _ in range(n))
            texts.append(t)
            for _ in range(4):  # each step changes a few characters of the one before
                w = list(t)
                for _ in range(max(1, n // 60)):
                    w[rng.randrange(n)] = rng.choice("xyz")
                t = "".join(w)
                texts.append(t)
    texts += ["", "", texts[0], texts[7], "q"]
    embedding = edit_embedding.Embedding()
    found = embedding.fingerprints([edit_embedding._points(t) for t in texts])
    near = edit_embedding.likenesses(embedding, found) >= edit_embedding.NEAR
    near |= np.array([[a == b for b in texts] for a in texts])
    least = np.arange(len(texts))
    while True:
        new = np.where(near, least[None, :], len(texts)).min(1)
        if (new == least).all():
            break
        least = new
    chained = sum(not near[i, least[i]] for i in range(len(texts)))
    rows = {r.doc_id: r.class_id for r in edit_embedding.fingerprint_edits(docs_of(spark, texts)).collect()}
    assert chained > 5 and all(rows[i] >= least[i] for i in rows)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near[i, j]]
    assert np.mean([rows[i] == rows[j] for i, j in pairs]) > 0.97


def test_op7_many_partitions(spark):
    rows = spark.range(3000).selectExpr("id * 7 - 900 as doc_id", "concat('text ', id, repeat('ab ', cast(id % 9 as int))) as text").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2000")
        bounds = edit_embedding.ranges(edit_embedding.keyed(rows), 2000)
        assert 1000 < len(bounds) <= 2000
        firsts = edit_embedding.F.split(edit_embedding.F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        placed = rows.select("doc_id", edit_embedding.range_of(edit_embedding.F.col("doc_id"), firsts, len(bounds)).alias("part")).collect()
        assert all(r.part == np.searchsorted(bounds, r.doc_id, side="right") - 1 for r in placed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op8_mix(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    size = {i: len(brute.words(t)) for i, t in enumerate(texts)}
    by_source = {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        by_source.setdefault(f"s{r.doc_id % 3}", []).append(r)
    total = sum(size.values())
    want = dict(zip(["s0", "s1", "s2"], (3, 1, 2)))
    sizes = {s: sum(size[r.doc_id] for r in rs) for s, rs in by_source.items()}
    level = 1.5 * total / 6
    free = dict(want)
    targets = {}
    while True:
        over = [s for s in free if level * want[s] > 2 * sizes[s]]
        for s in over:
            targets[s] = 2.0 * sizes[s]
            del free[s]
        if not over or not free:
            break
        level = (1.5 * total - sum(targets.values())) / sum(free.values())
    targets |= {s: level * w for s, w in free.items()}
    for s, rs in by_source.items():
        assert rs[0].source_size == sizes[s] and abs(rs[0].target - targets[s]) < 1e-6
        assert abs(sum(r.taken for r in rs) - targets[s]) <= 2 * max(r.size for r in rs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_op8_shared_ids_and_reruns(spark):
    """Ids that many rows share, ids in steps of 256, nulls: any partitioning gives the same rows."""
    rows = [((i % 7) * 256 if i % 3 else None, f"w {'x ' * (i % 5)}{i}", f"s{i % 2}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for f in (mixing.mix, mixing.mixed_rows):
        one, other = (sorted(map(tuple, f(docs.repartition(n)).collect()), key=str) for n in (3, 7))
        assert one == other


def test_op9_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(30):
        scores = [rng.normal(0, 3, (rng.integers(0, 7), 3)).astype(np.float32) for _ in range(5)]
        for s, labels in zip(scores, language_id.viterbi(scores, 2.0)):
            value = lambda p: sum(s[i, p[i]] for i in range(len(p))) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
            if len(s):
                assert abs(value(labels) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-4


def test_op9_held_out_accuracy(spark):
    found = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_op9_spans_and_scripts(spark):
    train = spark.createDataFrame([("the cat and the dog are here today", "en"), ("der hund und die katze sind heute hier", "de"), ("собака и кошка здесь сегодня", "ru")] * 3, "text string, lang string")
    model = language_id.fit(train)
    rows = spark.createDataFrame([(0, "the dog and the cat are here der hund und die katze sind hier собака здесь"), (1, "123 !!"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.language_spans(rows, model, ["doc_id"]).collect()}
    assert [s.lang for s in found[0].spans] == ["en", "de", "ru"] and [s.start for s in found[0].spans] == [0, 7, 14]
    assert found[1].lang_pred == found[2].lang_pred == "und" and found[2].score == 0


def test_op9_text_of_no_learned_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(5)
    unknown = [(10_000 + i, " ".join("".join(rng.choice("qxzjkvwyb") for _ in range(rng.randint(3, 9))) for _ in range(80)), None, "s", 1) for i in range(5)]
    kept = {r.doc_id for r in language_id.keep_identified(docs.unionByName(spark.createDataFrame(unknown, "doc_id long, text string, lang string, source string, n_chars long"))).collect()}
    with_letters = {r.doc_id for r in docs.collect() if r.text and len([c for c in r.text if c.isalpha()]) > 40}
    assert not kept & {u[0] for u in unknown} and len(with_letters - kept) <= 0.01 * len(with_letters)


def test_op4_other_vocabularies_read_whole_texts(spark):
    """A vocabulary that joins text across white space gets whole texts, so its ids are its own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = ["byte_bpe_50k.json"]
    texts = ["two  words", "new\nline x", "Ünï Café don't stop", ""]
    for name in other:
        tokenizer = Tokenizer.from_file(str(public_tokenizers.path(name)))
        rows = packing.pack(docs_of(spark, texts), path=str(public_tokenizers.path(name))).collect()
        for r in rows:
            ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids.tobytes())


@pytest.fixture
def dealt_to(spark):
    """Sets the number of shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 3, 13])
def test_op10_round_trip(spark, dealt_to, n):
    """Turns with nulls, control strings, ties and repeats, prefixes of one another, deep ones, and columns with clashing names."""
    dealt_to(n)
    rows = [(1, 0, "user", "hi <s>[x] \\ there"), (1, 1, "assistant", "</s>[INST] ok"), (2, 0, "user", "hi <s>[x] \\ there"), (2, 1, "assistant", None), (2, 2, "user", "é]"), (3, 0, None, "x"), (None, 0, "user", "a"), (None, None, "assistant", "b\\")]
    rows += [(10 + i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("user", "shared"), ("assistant", f"answer {i % 9}"), ("user", f"more {i % 15}")][: 2 + i % 2])]
    rows += [(60 + i, t, "assistant" if t % 2 else "user", f"deep {t}" if t < 70 - i else f"other {i} {t}") for i in range(3) for t in range(70)]
    rows += [(70, 0, "user", "twice"), (70, 0, "user", "twice"), (71, 1, "user", "b"), (71, 1, "assistant", "b"), (72, 0, "assistant", "long " * 30_000)]
    conversations = spark.createDataFrame([(*r, "x", "y", b"z") for r in rows], "conv_id long, turn int, role string, text string, turns string, leaf string, part binary")
    nodes, ends = chat_format.format_chats(conversations)
    nodes, ends = chat_format.cut(nodes), chat_format.cut(ends)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(nodes, ends).collect()}
    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    prefixes = set()
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"<s>[{chat_format.escape(r)}]{chat_format.escape(t)}</s>" for *_, r, t in turns)
        assert got[c] == (len(turns), brute.sha(said.encode()), len(learned), brute.sha(learned.encode()), len(whole))
        prefixes |= {tuple(x[2:] for x in turns[: k + 1]) for k in range(len(turns))}
    # every node once; each tree is laid out depth-first without gaps, and ancestors are where the intervals say
    every = nodes.collect()
    assert len(every) == len(prefixes) == len({bytes(x.node) for x in every})
    by_name, trees = {bytes(x.node): x for x in every}, {}
    for x in every:
        trees.setdefault(bytes(x.root), []).append(x)
        above, node = [], x
        while node.depth:
            node = by_name[bytes(node.parent)]
            above.append(node)
        # ancestors side by side are one interval
        runs = []
        for node in reversed(above):
            if runs and runs[-1][1] == node.offset:
                runs[-1][1] += node.length
            else:
                runs.append([node.offset, node.offset + node.length])
        assert len(above) == x.depth and x.position == sum(n.length for n in above) and [[i.start, i.stop] for i in x.attends] == runs
    for found in trees.values():
        found.sort(key=lambda x: x.offset)
        assert found[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in itertools.pairwise(found))
        for a, b in itertools.pairwise(found):
            assert b.depth <= a.depth + 1


def test_op10_one_turn_that_all_share(spark, dealt_to):
    """A shared first turn is emitted once, and the nodes below it spread over the ranges."""
    dealt_to(16)
    shared = spark.range(5000).selectExpr("id as conv_id", "array(struct(0 as turn, 'user' as role, 'shared' as text), struct(1 as turn, 'assistant' as role, concat('answer ', id) as text)) as t")
    nodes, ends = chat_format.format_chats(shared.selectExpr("conv_id", "inline(t)"))
    nodes = chat_format.cut(nodes)
    assert nodes.where("text = '<s>[user]shared</s>'").count() == 1 and nodes.count() == 5001
    sizes = [r["count"] for r in nodes.groupBy("part").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 2 * 5000 / 16
    assert chat_format.read_back(nodes, ends).where("n_turns = 2").count() == 5000


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_rows(spark, rows):
    """Nulls in any column, empty and long texts, ties, repeated rows, an empty table, clashing extra names."""
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA)
    n = len(rows)
    labels = spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert token_counts.token_counts(docs).count() == n
    assert fm_dedup.fm_dedup(docs).count() == n
    assert suffix_dedup.suffix_dedup(docs).count() == n
    assert packing.pack(docs).select("doc_id").count() >= n
    assert ngram_join.ngram_join(docs).count() == n
    assert quality_rules.quality_rules(docs, labels).count() == n
    assert edit_embedding.fingerprint_edits(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert language_id.identify(docs).count() == n
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
        docs = docs.cache()
        docs.count()


def test_odd_rows_by_value(spark):
    """What each operator gives for nulls, shared ids, repeated rows and a long word: rows count in the order of id (nulls first), then text."""
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in ODD))
    texts = [t for *_, t in rows]
    same = lambda found, want: sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str)
    ids = [i if there else None for there, i, _ in rows]
    found = token_counts.token_counts(docs).collect()
    assert same([(r.doc_id, r.n_words) for r in found], [(i, len(brute.words(t))) for i, t in zip(ids, texts)]) and all((r.n_tokens > 0) == (r.n_words > 0) for r in found)
    want = brute.windows_elsewhere(list(enumerate(texts)))
    assert same(fm_dedup.fm_dedup(docs).collect(), [(ids[k], *v) for k, v in want.items()])
    want = brute.strings_before(list(enumerate(texts)))
    assert same(suffix_dedup.suffix_dedup(docs).collect(), [(ids[k], *v[:4]) for k, v in want.items()])
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokens = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert same({(r.doc_id, r.doc_tokens) for r in packing.pack(docs).collect()}, set(zip(ids, tokens)))
    classes = brute.jaccard_classes(list(enumerate(texts)))
    found = ngram_join.ngram_join(docs).collect()
    by_class = lambda pairs: sorted((len([1 for _, c in pairs if c == k])) for k in {c for _, c in pairs})
    assert by_class([(r.key, r.class_key) for r in found]) == by_class([(k, v[0]) for k, v in classes.items()]) and all(r.n_links == 0 for r in found)
    labels = spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    found = quality_rules.quality_rules(docs, labels).collect()
    assert same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found], [(i, *brute.base_rules(t)) for i, t in zip(ids, texts)])
    untrained = quality_rules.quality_rules(docs, labels.where("quality = 9")).collect()
    assert all(r.kept == (not r.base_failed) for r in untrained)
    found = edit_embedding.fingerprint_edits(docs).collect()
    after = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    assert same([(r.doc_id, r.n_chars, r.edited_sha256) for r in found], [(i, len(t), brute.sha(e.encode())) for i, t, e in zip(ids, texts, edited)])
    assert len({r.class_id for r in found}) == len(set(texts)) and len({r.fingerprint for r in found}) == len(set(texts))
    assert same([(r.doc_id, r.size) for r in mixing.mix(docs).collect()], [(i, len(brute.words(t))) for i, t in zip(ids, texts)])
    found = language_id.identify(docs).collect()
    assert sum(r.lang_pred == "und" and r.score == 0 for r in found) == sum(not any(c.isalpha() for c in t) for t in texts)


@pytest.mark.parametrize("module", [fm_dedup, suffix_dedup])
def test_texts_above_a_slab(spark, module):
    """A document longer than what is laid out for one round of vector work, with repeats across the seams."""
    rng = random.Random(9)
    words = [f"{rng.randrange(36**3):x}" for _ in range(560_000 if module is fm_dedup else 130_000)]
    words[300_000 % len(words) : 300_000 % len(words) + 60] = words[100:160]
    words[-80:] = words[524_200 % len(words) :][:80]
    texts = [" ".join(words), " ".join(words[50:130])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if module is fm_dedup:
        want, found = brute.windows_elsewhere(list(enumerate(texts))), fm_dedup.fm_dedup(docs)
    else:
        want, found = {d: v[:4] for d, v in brute.strings_before(list(enumerate(texts))).items()}, suffix_dedup.suffix_dedup(docs)
    assert len(texts[0]) > repeats.SLAB and {r.doc_id: tuple(r)[1:] for r in found.collect()} == want


def test_walks_of_any_width(monkeypatch):
    """Documents walked one by one, or many side by side, give the same."""
    rng = random.Random(3)
    texts = [edit_embedding._points("".join(rng.choice("abc de") for _ in range(n))) for n in (0, 1, 5, 300, 301, 2000)]
    scores = [np.random.default_rng(n).normal(0, 3, (n, 3)).astype(np.float32) for n in (0, 1, 7, 40)]
    wide = edit_embedding.Embedding().fingerprints(texts), [x.tolist() for x in language_id.viterbi(scores, 2.0)]
    monkeypatch.setattr(edit_embedding, "MATRIX", 1)
    monkeypatch.setattr(language_id, "MATRIX", 1)
    assert (edit_embedding.Embedding().fingerprints(texts), [x.tolist() for x in language_id.viterbi(scores, 2.0)]) == wide


def test_odd_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.read_back(*chat_format.format_chats(empty)).count() == 0


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    docs = docs_of(spark, texts)
    first = corpus_pipeline.language_id(spark, docs, "")
    ids = {r.doc_id for r in first.collect()}
    assert {i for i, t in enumerate(texts) if not any(c.isalpha() for c in t)}.isdisjoint(ids)
    one = corpus_pipeline.ngram_join(spark, docs, "")
    want = brute.jaccard_classes(list(enumerate(texts)))
    kept = sorted(r.doc_id for r in one.collect())
    assert kept == sorted({v[0] for v in want.values()})
    cut = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, one, "").collect()}
    strings = brute.strings_before([(d, texts[d]) for d in kept])
    assert {d: r.text for d, r in cut.items()} == {d: v[4].decode("utf-8", "ignore") for d, v in strings.items()}
    assert all(r.n_chars == len(r.text) for r in cut.values())
    mixed = corpus_pipeline.mixing(spark, docs, "").groupBy("doc_id").count().collect()
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in mixed if texts[r.doc_id].split()} == taken


def plain_language(model, text, switch):
    """Label and share of a text: words scored one by one, and a best path kept for each language."""
    words = (text or "").encode().split()
    letters = [sum(c.isalpha() for c in w.decode()) for w in words]
    if not sum(letters):
        return "und", 0.0
    paths = None
    for w in words:
        own = model.scores(language_id.Words([w], model.buckets))[0].astype(float)
        if paths is None:
            paths = [(own[k], [k]) for k in range(len(own))]
            continue
        best = max(range(len(paths)), key=lambda k: paths[k][0])
        paths = [(max(paths[k][0], paths[best][0] - switch) + own[k], (paths[k][1] if paths[k][0] >= paths[best][0] - switch else paths[best][1]) + [k]) for k in range(len(own))]
    labels = max(paths, key=lambda p: p[0])[1]
    by_lang = [sum(n for n, k in zip(letters, labels) if k == lang) for lang in range(len(model.langs))]
    return model.langs[by_lang.index(max(by_lang))], max(by_lang) / sum(letters)


def test_op9_plain_version(spark, docs, texts):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    model = language_id.fit(real.select("text", "lang"))
    rows = {r.doc_id: r for r in language_id.language_spans(real.select("doc_id", "text"), model, ["doc_id"]).collect()}
    for r in real.collect():
        lang, share = plain_language(model, r.text, language_id.SWITCH)
        assert rows[r.doc_id].lang_pred == lang and abs(rows[r.doc_id].score - share) < 1e-6
        if rows[r.doc_id].spans:
            assert rows[r.doc_id].spans[0].start == 0 and rows[r.doc_id].spans[-1].stop == len(r.text.split())


def test_pipeline_from_end_to_end(spark, docs, texts, tmp_path):
    """run() over a table against plain versions of its stages, one after another."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = sorted(r.doc_id for r in language_id.keep_identified(docs).collect())
    classes = brute.jaccard_classes([(d, texts[d]) for d in kept])
    kept = sorted({v[0] for v in classes.values()})
    cut = {d: v[4].decode("utf-8", "ignore") for d, v in brute.strings_before([(d, texts[d]) for d in kept]).items()}
    left = spark.createDataFrame([(d, t, f"s{d % 3}") for d, t in cut.items()], "doc_id long, text string, source string")
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in mixing.copies(mixing.sized(left)).collect():
        ids = np.array([*tokenizer.encode(cut[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), packing.WINDOW):
            want += [(r.doc_id, a, min(packing.WINDOW, len(ids) - a), zlib.crc32(ids[a : a + packing.WINDOW].tobytes()))] * r.copies
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)


def test_op10_long_conversation(spark):
    """Twenty thousand turns in one conversation, and one that leaves it halfway: each node names a few runs of ancestors."""
    import time

    n = 20_000
    rows = [(1, i, "user", "ok") for i in range(n)] + [(2, i, "user", "ok" if i < n // 2 else "no") for i in range(n // 2 + 2)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    nodes, ends = chat_format.format_chats(given)
    found = {r.conv_id: (r.n_turns, r.formatted_chars) for r in chat_format.read_back(nodes, ends).collect()}
    assert found == {1: (n, n * 15), 2: (n // 2 + 2, (n // 2 + 2) * 15)}
    assert max(len(r.attends) for r in nodes.select("attends").collect()) == 2
    assert time.time() - began < 60
