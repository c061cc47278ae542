"""Streaming forms, run over the given files until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.streaming import incremental
from tesselar.workload.registry import query
from tesselar.workload.tables import cells, pixel_columns, raw, review_columns, rounded


def _stream(spark, sf, name):
    schema = raw(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _pixel_stream(spark, sf):
    n = raw(spark, sf, "embeddings").count()
    return pixel_columns(_stream(spark, sf, "lineitem"), F.lit(n))


@query(
    "stream_intensity_ranges",
    """SELECT channel, min(value)::DOUBLE AS data_min, max(value)::DOUBLE AS data_max,
       round(quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0), 6) AS auto_min,
       round(quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0), 6) AS auto_max FROM pixels GROUP BY channel""",
    "pixels",
)
def _(spark, sf):
    return rounded(incremental.intensity_ranges(_pixel_stream(spark, sf), incremental.stream_folder(spark, "ranges")))


@query("stream_tile_signal", "SELECT channel, id, round(avg(value) / 65535, 6) AS mean01 FROM pixels GROUP BY ALL", "pixels")
def _(spark, sf):
    return rounded(incremental.tile_sums(_pixel_stream(spark, sf), incremental.stream_folder(spark, "tiles")))


@query("stream_cluster_means", "SELECT level, cluster, channel, round(avg, 6) AS avg FROM means", "means")
def _(spark, sf):
    return rounded(incremental.cluster_means(_pixel_stream(spark, sf), cells(spark, sf), incremental.stream_folder(spark, "means")))


@query(
    "stream_review_snapshot",
    """SELECT level, cluster_id, model, event_id, status, user_title FROM (SELECT *, row_number() OVER (PARTITION BY level, cluster_id, model ORDER BY reviewed_at DESC, event_id DESC) AS r FROM reviews) WHERE r = 1""",
    "reviews",
)
def _(spark, sf):
    s = incremental.review_snapshot(review_columns(_stream(spark, sf, "events")), incremental.stream_folder(spark, "reviews"), "event_id")
    return s.select("level", "cluster_id", "model", "event_id", "status", "user_title")


@query("refreshed_dataset", "SELECT id, clustering FROM cells", "cells")
def _(spark, sf):
    root = incremental.stream_folder(spark, "dataset")
    incremental.refresh_dataset(spark, root, {"cells": lambda: cells(spark, sf)})
    return spark.read.parquet(f"{incremental.current_version(spark, root)}/cells").select("id", "clustering")
