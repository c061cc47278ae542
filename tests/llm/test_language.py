"""Language identification against a plain dictionary scorer."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tesselar.llm import language as lg


def plain_words(text):
    return ["".join(c for c in w) for w in re.split(r"[^a-zà-öø-ÿßœæ]+", text.lower()) if w]


def plain_scorer(rows):
    """Counts by dictionaries and one text scored word by word."""
    word, gram = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for doc_id, text, lang in rows:
        if None not in (doc_id, text, lang) and zlib.crc32(str(doc_id).encode()) % 5:
            for w in plain_words(text):
                word[lang][w] += 1
                for n in lg.GRAM_LENGTHS:
                    for g in lg.grams(w, n):
                        gram[lang][g] += 1
    languages = sorted(word)

    def logs(table, key):
        return [math.log(table[x][key] + lg.SMOOTHING) - math.log(sum(table[x].values()) + lg.SMOOTHING * len(table[x])) for x in languages]

    def known(table, key):
        return any(key in table[x] for x in languages)

    def score(text):
        found = plain_words(text or "")
        if not found:
            return "und", 0.0
        total = [0.0] * len(languages)
        for w in found:
            if known(word, w):
                some = [logs(word, w)]
            else:
                some = next(([logs(gram, g) for g in lg.grams(w, n) if known(gram, g)] for n in lg.GRAM_LENGTHS if any(known(gram, g) for g in lg.grams(w, n))), [])
            for i in range(len(languages)):
                total[i] += sum(v[i] for v in some) / max(1, len(some))
        best = max(range(len(languages)), key=lambda i: (total[i], -i))
        return languages[best], 1 / sum(math.exp(t - total[best]) for t in total)

    return score


@pytest.fixture(scope="module")
def rows(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 300), "lang")
    return [tuple(r) for r in docs.collect()]


def test_plain_dictionaries_agree(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lg.train(docs, train_docs=10**6, vocabulary=10**6, grams_kept=10**6)
    score = plain_scorer(rows)
    for r in lg.identify(docs, model).collect():
        lang, value = score(next(t for d, t, _ in rows if d == r.doc_id))
        assert r.lang_pred == lang and abs(r.score - value) < 1e-3


def test_letters_by_category(spark, rows):
    model = lg.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = ["½", "12 ² !!", "Ⅳ ⅷ", "①②", "", None, "_ - 7", "́"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in lg.identify(docs, model).collect()} == {("und", 0.0)}
    assert lg.words("a½b Ⅳx ÉTÉ_été 日本1語") == ["a", "b", "x", "été", "été", "日本", "語"]


def test_a_rare_language_is_learned(spark):
    """A few documents of one language among many of another with far more frequent words, and a small vocabulary."""
    common = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + i % 26)}" for j in range(60)), "big") for i in range(400)]
    rare = [(1000 + i, " ".join(f"zq{chr(97 + (7 * j + i) % 26)}{chr(97 + j % 26)}" for j in range(12)), "rare") for i in range(12)]
    docs = spark.createDataFrame(common + rare, "doc_id bigint, text string, lang string")
    model = lg.train(docs, vocabulary=100, grams_kept=100)
    assert model.languages == ["big", "rare"] and 50 <= len(model.word.row) <= 100 and len(model.gram.row) <= 100
    found = {r.doc_id: r.lang_pred for r in lg.identify(docs, model).collect()}
    assert all(found[d] == lang for d, _, lang in common + rare)
