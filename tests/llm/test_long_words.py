"""Words that defeat polynomial hashes: equal but for such a word is not equal."""

from tests.llm import brute
from veil.llm import fm_dedup, ngram_join


def self_similar(length, swap=False):
    """The string of a and b by the parity of each place's ones, or its complement."""
    return "".join("ab"[(i.bit_count() & 1) ^ swap] for i in range(length))


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_windows_that_differ_in_a_long_word(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:20] + [self_similar(2048, swap)] + words[20:]) for swap in (False, True)]
    texts += [" ".join(words[:20] + [self_similar(64, swap)] + words[20:]) for swap in (False, True)] + [texts[0] + " more"]
    want = brute.windows_elsewhere(list(enumerate(texts)))
    found = {r.doc_id: tuple(r)[1:] for r in fm_dedup.fm_dedup(documents(spark, texts)).collect()}
    assert found == {d: tuple(v[:3]) for d, v in want.items()}
    assert [found[i][1] for i in range(4)] == [41, 0, 0, 0]


def test_sets_that_differ_in_a_long_word(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:20] + [self_similar(2048, swap)] + words[20:]) for swap in (False, True)]
    texts += [self_similar(2048), self_similar(2048, True), self_similar(1024), self_similar(1024, True)]
    docs = documents(spark, texts).cache()
    for _ in range(10):
        found = sorted((r.doc_id, r.class_key, r.copy_key, r.n_links) for r in ngram_join.ngram_join(docs).collect())
        assert found == [(i, i, i, 0) for i in range(6)]
