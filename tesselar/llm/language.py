"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language.  An unseen word falls back to its longest
n-grams of which any is known, so a new inflection still counts for its language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.llm.common import cut, held_out

# Documents per language that are counted (in expectation), words and n-grams kept over all languages, n-gram lengths
# from long to short.
TRAIN_DOCS, VOCABULARY, GRAMS, GRAM_LENGTHS = 3_000, 200_000, 200_000, (5, 4, 3, 2, 1)
SMOOTHING = 0.1
CACHE_WORDS = 300_000
UNDETERMINED = "und"

# Letters by Unicode category; the characters that str counts as word characters include signs of numbers.
_WORD = regex.compile(r"\p{L}+")
_PLAIN_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _PLAIN_WORD.findall(text.lower())
    return found if text.isascii() else [w for f in found for w in ((f,) if f.isalpha() else _WORD.findall(f))]


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between boundary marks; single characters without the marks."""
    padded = word if n == 1 else f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Logs:
    """Log frequencies of strings: a row number per string and one matrix with a column per language."""

    def __init__(self, keys: list[str], counts: np.ndarray, totals: np.ndarray, entries: np.ndarray):
        """``totals`` and ``entries`` are a language's sum of counts and number of different strings, kept or not."""
        self.row = {k: i for i, k in enumerate(keys)}
        self.logs = (np.log(counts + SMOOTHING) - np.log(totals + SMOOTHING * np.maximum(entries, 1))).astype(np.float32)

    def get(self, key: str) -> np.ndarray | None:
        at = self.row.get(key)
        return None if at is None else self.logs[at]


class Model(NamedTuple):
    languages: list[str]
    word: Logs
    gram: Logs


class Scorer:
    """A worker's view of the model: word → row of one growing matrix."""

    def __init__(self, model: Model):
        self.model = model
        self.none = np.zeros(len(model.languages), dtype=np.float32)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.used = 0
        self.matrix = np.zeros((1 << 12, len(self.model.languages)), dtype=np.float32)

    def vector(self, word: str) -> np.ndarray:
        known = self.model.word.get(word)
        if known is not None:
            return known
        for n in GRAM_LENGTHS:
            some = [v for g in grams(word, n) if (v := self.model.gram.get(g)) is not None]
            if some:
                return np.mean(some, axis=0, dtype=np.float32)
        return self.none

    def add(self, word: str) -> int:
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.used] = self.vector(word)
        self.row[word] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.row) > CACHE_WORDS:
            self._clear()
        get = self.row.get
        rows = [r if (r := get(w)) is not None else self.add(w) for w in found]
        total = self.matrix[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def _table(counted: DataFrame, key: str, languages: list[str], bound: int) -> Logs:
    """The most frequent strings of every language, with their counts in all languages.

    Each language has an equal share of ``bound``, so a rare one keeps its words; ties go by a hash of the string.
    """
    share = max(1, bound // max(1, len(languages)))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64(key), key)
    chosen = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).select(key).distinct()
    kept = counted.join(chosen, key, "left_semi").select(key, "lang", "n").toPandas()
    about = {r["lang"]: r for r in counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("entries")).collect()}
    keys, row = np.unique(kept[key].to_numpy(dtype=object), return_inverse=True) if len(kept) else (np.array([], dtype=object), [])
    counts = np.zeros((len(keys), len(languages)))
    counts[row, kept["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)] = kept["n"]
    number = lambda c: np.array([float(about[name][c]) if name in about else 0.0 for name in languages])
    return Logs(list(keys), counts, number("total"), number("entries"))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, vocabulary: int = VOCABULARY, grams_kept: int = GRAMS) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: rows without id, text or lang and held-out rows never train.

    About ``train_docs`` documents of each language are counted (a fixed hash of the id decides).  n-grams are counted over
    all words of the sample.  ``vocabulary`` words and ``grams_kept`` n-grams are kept, in equal shares per language, so the
    model has a fixed bound.
    """
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)
    )
    sizes = cut(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.lit(float(train_docs)) / F.col("n")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(sizes, "lang").filter(place < share).select("text", F.col("lang").cast("string").alias("lang"))

    def rows(key: str, by: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, found in by.items():
            if found:
                yield pd.DataFrame({"lang": [lang] * len(found), key: list(found), "n": list(found.values())})

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(batch["text"], batch["lang"]):
                by.setdefault(lang, Counter()).update(words(text))
            yield from rows("word", by)

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for word, lang, n in zip(batch["word"], batch["lang"], batch["n"]):
                here = by.setdefault(lang, Counter())
                for length in GRAM_LENGTHS:
                    # The length is part of the key: a boundary mark never meets a longer n-gram.
                    for g in grams(word, length):
                        here[g] += n
            yield from rows("gram", by)

    counted = cut(sample.mapInPandas(count_words, "lang string, word string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")), "word-counts")
    by_gram = cut(counted.mapInPandas(count_grams, "lang string, gram string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "gram-counts")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    return Model(languages, _table(counted, "word", languages, vocabulary), _table(by_gram, "gram", languages, grams_kept))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, lang_pred, score: the best language and its share of the likelihood.

    Only the text enters a prediction, and all of it.  A NULL text and one without any letter are ``und`` with score 0;
    ties go to the language that comes first by name.  Repeated rows and rows without id are scored like any other; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = [scorer(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return docs.select("doc_id", best(F.col("text")).alias("b")).select("doc_id", "b.*")
