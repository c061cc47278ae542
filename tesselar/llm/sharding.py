"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory.  Pass two shuffles each bucket by
Fisher-Yates (what Spark's ``shuffle`` function does on an array).  The buckets in order are one random sequence of all
records; record number g goes to shard g mod n at place g div n, so shard sizes differ by one row at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.llm.common import cut
from tesselar.scale import shared_dir

# Bytes of records that one bucket holds on average.
BUCKET_BYTES = 1 << 20
# Buckets per run of the two-level offset sum.
RUN = 1024


def external_shuffle(df: DataFrame, size: str, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` plus shard (int, 0 to shards−1) and slot (long, gapless from 0 in each shard).

    ``size`` names the column with a record's bytes (NULL counts as 0).  Every row is placed, also rows with NULLs and
    repeated rows: the scatter hash covers all columns and the row's position in its input split, so equal rows do not
    meet in one bucket.  An empty table gives an empty result.  Existing columns may have any name but shard and slot,
    which are replaced.  The placed rows are written once, so a lost executor cannot change the order.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    df = df.drop("shard", "slot")
    total = df.agg(F.sum(F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("double")).alias("b")).first()["b"] or 0.0
    buckets = max(1, int(-(-total // bucket_bytes)))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    scattered = df.select(row.alias("row"), F.monotonically_increasing_id().alias("nth")).select(
        "row", "nth", F.pmod(F.xxhash64(F.lit(seed), "row", "nth"), F.lit(buckets)).alias("bucket"),
    )
    filled = (
        scattered.repartition("bucket").groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "row"))).alias("rows"))
        .sortWithinPartitions("bucket")
    )
    placed = cut(
        filled.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "r")).select("bucket", "pos", "r.row"), "shuffled",
    )
    counts = cut(placed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN)), "buckets")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select(
        "run", F.coalesce(F.sum("n").over(before(Window.orderBy("run"))), F.lit(0)).alias("base"),
    )
    first = F.coalesce(F.sum("n").over(before(Window.partitionBy("run").orderBy("bucket"))), F.lit(0))
    starts = counts.select("bucket", "run", first.alias("first")).join(runs, "run").select("bucket", (F.col("first") + F.col("base")).alias("start"))
    place = F.col("start") + F.col("pos")
    return placed.join(cut(starts, "starts"), "bucket").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)],
        (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the files of a shard follow each other in slot order, a large shard has several."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def stored(sharded: DataFrame) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    path = f"{shared_dir(sharded.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
