"""The language model: contexts are whole words, and the probabilities of a corpus that leaves nothing to chance."""

import math
import zlib

import pytest

from tesselar.llm import pitman_yor


def ids(held):
    return (i for i in range(100_000) if (zlib.crc32(str(i).encode()) % 5 == 1) == held)


def scores(spark, train, probes):
    rows = [*zip(ids(False), train), *zip(ids(True), probes)]
    found = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    return [found[i] for i, _ in zip(ids(True), probes)]


def test_words_of_one_ending_are_different_contexts(spark):
    left, right = scores(spark, ["walking left", "talking right"] * 40, ["walking left", "walking right"])
    assert left > right + 1


@pytest.mark.parametrize("bucket_bytes", [4, 1 << 24])
def test_single_customers_have_exact_probabilities(spark, monkeypatch, bucket_bytes):
    # Every word and pair occurs once, so every customer has a table of its own, whatever is drawn.
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", bucket_bytes)
    train, probes = "a b c d e f".split(), ["a b zz", "c a", "zz", ""]
    pairs = dict(zip([None, *train], [*train, None]))
    n, d = len(pairs), 0.95
    chance = lambda w: ((1 - d if w in pairs else 0.0) + (1 + d * n) / (n + 1)) / (1 + n)
    found = scores(spark, [" ".join(train)], probes)
    for text, score in zip(probes, found):
        words = text.split()
        want = 0.0
        for u, w in zip([None, *words], [*words, None]):
            c = int(u in pairs)
            want += math.log10((c * (1 - d) * (u in pairs and pairs[u] == w) + (1 + d * c) * chance(w)) / (1 + c))
        assert score == pytest.approx(want, rel=1e-9)

