"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Toxic documents go, one document of each group of near-duplicates stays, passages that repeat are cut out of the later
texts, documents that hold a benchmark window go, and what is left is encoded and decoded.

Every stage takes documents with NULLs in any column, empty and long texts, repeated rows and further columns, and an empty
table gives an empty result.  What a stage does with them is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import byte_bpe, decontamination, simhash, suffix_dedup, toxicity
from tesselar.llm.common import cut, table
from tesselar.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; fitted on the labelled documents among ``docs``.

    NULL and empty texts score like a text without any term; repeated rows go or stay together; rows without id never
    train but are judged.  Without a usable label every score is one half and all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash group.

    Texts without words (NULL, empty) are one group.  Of repeated rows of an id one stays; rows without id link with
    nothing and all stay.
    """
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings that also start earlier; a column n_chars follows the text.

    No row goes.  NULL texts stay NULL (and their n_chars NULL); repeated rows of one id and text count as one document;
    rows without id come after all others.
    """
    left = suffix_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    NULL and empty texts have no words and stay; repeated rows and rows without id are judged like any other.
    """
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of every row that is left, as digests; NULL and empty texts have no ids."""
    import public_tokenizers

    return byte_bpe.token_digests(byte_bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

# Learned scores, fingerprints and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
