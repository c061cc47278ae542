"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.scale import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
AZ_LOWER = str.maketrans(UPPER, LOWER)
_UPPER_RUN = re.compile("[A-Z]+")
# The six white-space bytes that end a word, and all other characters at which str.split() would cut.
_WORD_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Only A-Z change; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a row without id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """Rows of the test fold.  A row without id never trains, so it counts as held out."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(True))


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and one struct of all other columns, so that no column of the caller clashes with a helper's."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("rest"))


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the frame that was wrapped."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)])


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    return materialise(df, label)


def lower_az_text(text: str) -> str:
    """The same for a Python string."""
    return text.lower() if text.isascii() else _UPPER_RUN.sub(lambda m: m[0].lower(), text)


def words_of(text: str) -> list[str]:
    """Lower-cased words between ASCII white space."""
    text = lower_az_text(text)
    # str.split() also cuts at other spaces and separators, so it serves only texts without them.
    return text.split() if _OTHER_SPACE.search(text) is None else [w for w in _WORD_SPACE.split(text) if w]
