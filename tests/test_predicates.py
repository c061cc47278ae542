"""Filter text: what it accepts, what it refuses, and rows on which it is undefined."""

import json

import pytest
from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.operators import selection
from tesselar.sources import documents

NAMES = {"id": "id", "n": "n", "t": "t", "ct": "t"}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, 4, "abc"), (2, 0, "7"), (3, None, None), (4, 9223372036854775807, ""), (5, -3, "ABC")], "id bigint, n bigint, t string",
    )


def ids(rows, text):
    return sorted(r.id for r in selection.filter_expression(rows, NAMES, text).collect())


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("n > 1", [1, 4]),
        ("10 / n > 1", [1, 2]),  # a zero divisor gives infinity
        ("n % 0 == 1", []),
        ("n % 0 != 1", []),
        ("n % 0 != 1 || id > 3", [4, 5]),
        ("t > 3", [2]),  # text that is no number is undefined
        ("t == 'abc' || ct == \"ABC\"", [1, 5]),
        ("!(n > 1)", [2, 5]),
        ("n * n * n > 0", [1, 4]),  # no overflow
        ("n in [4, -3]", [1, 5]),
        ("n == null", [3]),
        ("t", [1, 2, 5]),
        ("-n == 3 && true", [5]),
        ("t + 1 === 'abc1'", [1]),
    ],
)
def test_values(rows, text, wanted):
    assert ids(rows, text) == wanted


@pytest.mark.parametrize(
    "text",
    ["reflect('java.lang.System', 'getProperty', 'user.home') == '/root'", "java_method('a', 'b')", "n in (select 3)", "select", "n.x > 1",
     "t('a')", "n & 1", "n = 1", "unknown > 1", "(n > 1", "n >", "", "n; 1", "n in [1", "[1]"],
)
def test_refused(rows, text):
    with pytest.raises(ValueError):
        selection.filter_expression(rows, NAMES, text)


def test_order_hash_of_any_id(spark):
    big = [0, 1, 2**31, 4_000_000_000, 2**62, -1, -(2**62)]
    got = spark.createDataFrame([(i,) for i in big], "id bigint").select("id", scalars.order_hash(F.col("id"), 42).alias("h")).collect()
    assert {r.id: r.h for r in got} == {i: ((i + 42) * 2654435761) % 2**32 for i in big}


def test_label_document_quotes_keys(spark):
    df = spark.createDataFrame([(0, 'a"b\\c', "m", 'T"', "D")], "level bigint, cluster_id string, model string, title string, description string")
    doc = json.loads(documents.label_document(df).first().doc)
    assert doc == {"levels": {"0": {'a"b\\c': {"models": {"m": {"title": 'T"', "description": "D"}}}}}}


def test_review_document_round_trip(spark):
    df = spark.createDataFrame(
        [(1, "c", "m", "accepted", "old", "u", 0.5, 1.0, "2024-01-01 00:00:00"), (1, "c", "m", "rejected", "new", "u", 0.25, None, "2024-02-01 00:00:00")],
        "level bigint, cluster_id string, model string, status string, llm_title string, user_title string, llm_accuracy double, confidence double, reviewed_at string",
    ).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    out = documents.review_document(df, F.lit("2025-01-02 03:04:05").cast("timestamp"))
    doc = json.loads(out.first().doc)
    assert doc["version"] == 2 and doc["updated_at"].startswith("2025-01-02T03:04:05")
    back = documents.review_documents(out).collect()
    assert [(r.level, r.cluster_id, r.model, r.status, r.llm_title) for r in back] == [("1", "c", "m", "rejected", "new")]
    empty = json.loads(documents.review_document(df.limit(0), F.current_timestamp()).first().doc)
    assert empty["levels"] == {}
