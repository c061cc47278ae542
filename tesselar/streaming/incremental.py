"""Incremental operators over file streams of pixels and reviews.

Every sink writes folders named by the micro-batch and overwrites them when the batch is replayed, so a restart after a
failure gives the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.operators import clusters, composition, intensity
from tesselar.scale import shared_dir
from tesselar.streaming.changelog import ChangeLog


def stream_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop."""
    (
        stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def _counts_log(path: str) -> ChangeLog:
    # Counts only rise, so the highest one of a value is the last.
    return ChangeLog(f"{path}/table", lambda t: t.groupBy("channel", "value").agg(F.max("n").alias("n")))


def intensity_counts(stream: DataFrame, path: str) -> DataFrame:
    """Running (channel, value) counts, at most 65536 values per channel.

    The counts live in the state store; a batch writes only the values that it changed.
    """
    log = _counts_log(path)
    counts = stream.groupBy("channel", "value").agg(F.count("*").alias("n"))
    run_available(counts, log.append, f"{path}/state", "update")
    return log.read(stream.sparkSession)


def intensity_ranges(stream: DataFrame, path: str) -> DataFrame:
    """Per-channel range and automatic window refined as pixels arrive; equals the batch result."""
    return intensity.channel_ranges(intensity_counts(stream, path), ["channel"])


def _sums(keys: list[str]):
    return lambda t: t.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def _partial(pixels: DataFrame) -> DataFrame:
    """One sum and count per (channel, id): what every later step needs of a batch's pixels."""
    return pixels.groupBy("channel", "id").agg(F.sum("value").alias("s"), F.count("*").alias("c"))


def tile_sums(stream: DataFrame, path: str) -> DataFrame:
    """Per-tile means: each batch adds partial sums, reading merges them."""
    log = ChangeLog(f"{path}/table", _sums(["channel", "id"]))
    run_available(stream, lambda df, batch_id: log.append(_partial(df), batch_id), f"{path}/state")
    return log.read(stream.sparkSession).select("channel", "id", (F.col("s") / F.col("c") / 65535.0).alias("mean01"))


def cluster_means(stream: DataFrame, cells: DataFrame, path: str) -> DataFrame:
    """Cluster × channel means: a batch's pixels collapse to sums per cell, meet the labels, and only then the levels."""
    keys = ["level", "cluster", "channel"]
    log = ChangeLog(f"{path}/table", _sums(keys))
    labels = clusters.level_columns(cells) or ["clustering"]

    def add(df: DataFrame, batch_id: int) -> None:
        wide = _partial(df).join(cells.select("id", *labels), "id")
        log.append(clusters.unpivot_levels(wide, ["channel", "s", "c"]), batch_id)

    run_available(stream, add, f"{path}/state")
    return log.read(stream.sparkSession).select(*keys, (F.col("s") / F.col("c")).alias("avg"))


def review_snapshot(stream: DataFrame, path: str, tie: str | None = None) -> DataFrame:
    """Last-write-wins review table: every batch adds its newest rows per key, reading merges them.

    Invalid rows land next to them in ``rejected``.
    """
    log = ChangeLog(f"{path}/table", lambda t: composition.latest_reviews(t, tie))

    def add(df: DataFrame, batch_id: int) -> None:
        good, bad = composition.valid_reviews(df)
        bad.write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id:010d}")
        log.append(good, batch_id)

    run_available(stream, add, f"{path}/state")
    return log.read(stream.sparkSession)


def refresh_dataset(spark: SparkSession, root: str, builders: dict[str, Callable[[], DataFrame]]) -> dict[str, str]:
    """Rebuild derived tables under a new version folder and publish it only when all are complete.

    Readers follow the newest version that has a marker row, so a failed rebuild changes nothing.
    """
    version = f"{root}/version={uuid.uuid1().hex}"
    paths = {}
    for name, build in builders.items():
        paths[name] = f"{version}/{name}"
        build().write.parquet(paths[name])
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at")).coalesce(1).write.mode("append").parquet(f"{root}/published")
    return paths


def current_version(spark: SparkSession, root: str) -> str:
    """Folder of the last published version."""
    return spark.read.parquet(f"{root}/published").agg(F.max_by("version", "published_at")).first()[0]
