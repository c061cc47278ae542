import pytest
from pyspark.sql import functions as F

PASSAGE = "the quick brown fox jumps over the lazy dog and then some more words to reach one hundred bytes at the very least ok "
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit string, shard int, rest int, root int, label int"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty and long texts, repeated rows, large ids and columns with clashing names."""
    texts = [
        (None, None, None), (None, "abc", "en"), (1, "", "en"), (2, None, "fr"), (3, PASSAGE * 3, "en"), (3, PASSAGE * 3, "en"),
        (4, "x" + PASSAGE, "en"), (5, " ".join(f"w{i}" for i in range(30_000)), None), (9007199254740993, "é" * 200 + PASSAGE, "fr"),
        (6, " \t\n", "de"), (7, "12 34 !!", "de"),
    ]
    return spark.createDataFrame([(*t, None, None, None, 1, 1, 1, 1) for t in texts], DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def texts_of(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", F.coalesce("text", F.lit(""))).collect()}
