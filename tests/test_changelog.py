"""Keyed change log: results of any number of batches, replays, restarts, and what a batch writes."""

import os

import pytest
from pyspark.sql import functions as F

from tesselar.operators import intensity
from tesselar.operators.composition import latest_reviews
from tesselar.streaming import incremental
from tesselar.streaming.changelog import ChangeLog
from tesselar.workload import tables

SF = "/root/testdata/sf0.001"


def log_of(path, fan=3):
    return ChangeLog(str(path), lambda t: t.groupBy("k").agg(F.sum("n").alias("n")), fan)


def test_runs_cover_every_batch_once(tmp_path):
    log = log_of(tmp_path)
    for last in range(200):
        spans = []
        for run in log.runs(last):
            level, upto = (int(part.split("=")[1]) for part in run.split("/")[-2:])
            spans += range(upto + 1 - 3**level, upto + 1)
        assert spans == list(range(last + 1)) and len(log.runs(last)) <= 2 * 6


def test_batches_replays_and_an_unfinished_batch(spark, tmp_path):
    log, want = log_of(tmp_path / "log"), {}
    for batch in range(10):
        rows = [(i % 4, i) for i in range(batch, batch + 3)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(1 + batch % 2):  # every other batch runs twice
            log.append(spark.createDataFrame(rows, "k bigint, n bigint"), batch)
        assert {r.k: r.n for r in log.read(spark).collect()} == want
    spark.createDataFrame([(0, 99)], "k bigint, n bigint").write.parquet(log._run(0, 10))
    assert {r.k: r.n for r in log.read(spark).collect()} == want


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def key(df, cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.fixture
def parts(spark, tmp_path):
    """Nine files of pixels and of reviews, written one by one."""
    px, reviews = tables.pixels(spark, SF), tables.reviews(spark, SF)

    def arrive(numbers):
        for i in numbers:
            px.filter(F.pmod(F.xxhash64("id", "channel", "y", "x"), F.lit(9)) == i).coalesce(1).write.parquet(str(tmp_path / f"px/in{i}"))
            reviews.filter(F.col("event_id") % 9 == i).coalesce(1).write.parquet(str(tmp_path / f"rv/in{i}"))

    def stream(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))

    return arrive, lambda: stream("px", px.schema), lambda: stream("rv", reviews.schema), px, reviews


def test_streams_restart_and_write_no_history(spark, tmp_path, parts):
    arrive, pixels, reviews, all_pixels, all_reviews = parts
    out = str(tmp_path / "out")
    jobs = {
        "ranges": lambda: incremental.intensity_ranges(pixels(), f"{out}/ranges"),
        "means": lambda: incremental.cluster_means(pixels(), tables.cells(spark, SF), f"{out}/means"),
        "reviews": lambda: incremental.review_snapshot(reviews(), f"{out}/reviews", "event_id"),
    }
    arrive(range(4))
    for job in jobs.values():
        job().collect()
    arrive(range(4, 9))
    got = {name: job() for name, job in jobs.items()}
    cols = ["channel", "data_min", "data_max", "auto_min", "auto_max"]
    assert key(got["ranges"], cols) == key(intensity.channel_ranges(intensity.value_counts(all_pixels, ["channel"]), ["channel"]), cols)
    from tesselar.operators.clusters import cluster_channel_means

    cols = ["level", "cluster", "channel", "avg"]
    assert key(got["means"], cols) == key(cluster_channel_means(all_pixels, tables.cells(spark, SF)), cols)
    cols = ["level", "cluster_id", "model", "event_id"]
    assert key(got["reviews"], cols) == key(latest_reviews(all_reviews, "event_id"), cols)
    for name in jobs:
        runs = sorted(os.listdir(f"{out}/{name}/table/level=0"))
        sizes = [size(f"{out}/{name}/table/level=0/{r}") for r in runs]
        assert len(sizes) == 9 and max(sizes[4:]) < 1.5 * max(sizes[:4])
        # The one merge of eight batches is all that was written besides.
        assert os.listdir(f"{out}/{name}/table/level=1") == ["upto=0000000007"]
