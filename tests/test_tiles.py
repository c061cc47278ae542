"""The tile store: files in key order, bounded in number, and scans that skip row groups."""

import os

import pytest
from pyspark.sql import functions as F

from tesselar.sources import cells


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_scan_skips_row_groups(spark, tmp_path, plain_plans):
    tile = spark.range(6 * 400 * 16).select(
        (F.col("id") % 6).alias("channel"), (F.floor(F.col("id") / 6) % 400).alias("id"), (F.floor(F.col("id") / 2400) % 4).alias("y"),
        F.floor(F.col("id") / 9600).alias("x"), (F.xxhash64("id") % 1000 + 1000).alias("value"),
    )
    path = str(tmp_path / "tiles")
    cells.write_tiles(tile, path, 10, row_group_bytes=4096)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) <= 4 and not [f for f in os.listdir(path) if f.startswith("channel=")]
    got = cells.scan_tiles(spark, path, 4, channels=[2], chunks=[7, 8])
    want = tile.filter("channel = 2 AND id >= 70 AND id < 90")
    columns = ["channel", "id", "y", "x", "value"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    counted = got.select("channel", "id", "chunk_id", "y", "x", "value")
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 20 <= read < 0.5 * 2400


def test_all_channels_and_chunks(spark, tmp_path):
    tile = spark.range(64).select((F.col("id") % 2).alias("channel"), F.floor(F.col("id") / 32).alias("id"), (F.floor(F.col("id") / 2) % 4).alias("y"), (F.floor(F.col("id") / 8) % 4).alias("x"), F.col("id").alias("value"))
    cells.write_tiles(tile, str(tmp_path / "t"), 1)
    back = cells.scan_tiles(spark, str(tmp_path / "t"), 4)
    assert sorted(map(tuple, back.select("channel", "id", "y", "x", "value").collect())) == sorted(map(tuple, tile.select("channel", "id", "y", "x", "value").collect()))
