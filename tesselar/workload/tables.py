"""The logical tables derived from the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_CHUNK = 64
CHANNELS = list(range(7))


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark, sf) -> DataFrame:
    return raw(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def cells(spark, sf) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    v, l = F.col("vec_id"), F.col("label")
    return raw(spark, sf, "embeddings").select(
        v.alias("id"),
        l.cast("bigint").alias("clustering"),
        e(0).alias("umap2_x"), e(1).alias("umap2_y"),
        e(2).alias("umap3_x"), e(3).alias("umap3_y"), e(4).alias("umap3_z"),
        ((v % 25) * 10 + e(5)).alias("X_centroid"),
        (F.floor(v / 25) * 10 + e(6)).alias("Y_centroid"),
        F.lit(0).cast("bigint").alias("cluster_L0"),
        (l % 3).cast("bigint").alias("cluster_L1"),
        ((l + v) % 6).cast("bigint").alias("cluster_L2"),
        l.cast("bigint").alias("cluster_L3"),
        ((l * 7 + v) % 15).cast("bigint").alias("cluster_L4"),
        ((l * 3 + v) % 20).cast("bigint").alias("cluster_L5"),
    )


def pixel_columns(lineitem: DataFrame, n_cells) -> DataFrame:
    ident = F.col("l_partkey") % n_cells
    return lineitem.select(
        (F.col("l_linenumber") - 1).cast("bigint").alias("channel"),
        ident.alias("id"),
        F.floor(ident / PER_CHUNK).cast("bigint").alias("chunk_id"),
        (F.col("l_suppkey") % 8).alias("y"),
        (F.col("l_orderkey") % 8).alias("x"),
        (F.floor("l_extendedprice").cast("bigint") % 65536).alias("value"),
    )


def pixels(spark, sf) -> DataFrame:
    n = raw(spark, sf, "embeddings").agg(F.count("*")).scalar()
    return pixel_columns(raw(spark, sf, "lineitem"), n)


def annotations(spark, sf) -> DataFrame:
    return raw(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("celltype"), F.col("p_brand").alias("neigh_names"),
        "p_size", "p_retailprice",
    )


def regions(spark, sf) -> DataFrame:
    e = raw(spark, sf, "embeddings")
    part = lambda r, labels: e.filter(F.col("label").isin(labels)).select(F.lit(r).cast("bigint").alias("region"), F.col("vec_id").alias("id"))
    return part(0, [0, 1]).unionByName(part(1, [1, 2]))


def label_groups(spark, sf) -> DataFrame:
    return raw(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("group"), F.col("vec_id").alias("id"))


def points(spark, sf) -> DataFrame:
    return raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 500000).alias("x"),
        ((F.col("o_custkey") % 997) / F.lit(997.0)).alias("y"), F.col("o_totalprice").alias("score"),
    )


def review_columns(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return events.select(
        "event_id",
        (F.col("user_id") % 6).cast("string").alias("level"),
        (F.col("user_id") % 20).cast("string").alias("cluster_id"),
        F.col("event_type").alias("model"),
        F.when(i % 4 == 0, "accepted").when(i % 4 == 1, "rejected").when(i % 4 == 2, "unsure").otherwise("corrected").alias("status"),
        F.concat(F.lit("title "), i.cast("string")).alias("llm_title"),
        F.when(i % 5 == 0, F.concat(F.lit("user "), i.cast("string"))).otherwise(F.lit("")).alias("user_title"),
        (F.col("value") / 10).alias("llm_accuracy"),
        (F.floor("value") / 2).alias("confidence"),
        F.col("ts").alias("reviewed_at"),
    )


def reviews(spark, sf) -> DataFrame:
    return review_columns(raw(spark, sf, "events"))


def channels(spark) -> DataFrame:
    """Names of the seven channels that the pixel table uses."""
    return spark.range(len(CHANNELS)).select(
        "id", F.concat(F.lit("ch_"), F.col("id").cast("string")).alias("name"), F.col("id").alias("ome_c"), F.col("id").alias("zarr_c")
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (with −0.0 turned into 0.0)."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
