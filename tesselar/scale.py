"""Helpers that keep plans safe at any size: written intermediates and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest driver-side side input (query vectors, centroids) shipped inside a task closure.
CLOSURE_LIMIT_BYTES = 32 * 1024 * 1024
# Private folders of local sessions that name no shared one, by application.
_PRIVATE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only for local sessions that name none (unit tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="tesselar-")
    return _PRIVATE[app]


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan must be cut (iterations), where a nondeterministic step must run exactly
    once, and for aggregated side inputs: the files give Catalyst the true size, so it broadcasts
    a really small side by itself and falls back to a shuffle join otherwise.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_rows(df: DataFrame) -> DataFrame:
    """A side of a join that has a row, or part of a packed row, per item: it is never sent through the driver."""
    return df.hint("merge")


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a scalar-subquery struct; no join is planned for it."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).scalar()


def numbers(n: int) -> Column:
    """Generator of 0..n−1 as bigint."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank_col: str = "rank") -> DataFrame:
    """0-based dense position inside each key, ordered by ``order`` (which must end in a unique id).

    ``row_number() over (partition by keys)`` would sort a whole key in one task, and one key may
    hold a third of the table or all of it.  Here rows are range-partitioned by (keys, order), so a
    hot key is spread over many tasks; each task numbers its own rows and the start offset of every
    (key, task) run comes from a tiny aggregate.
    """
    cols = [*keys, *order]
    placed = materialise(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(
        placed.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n"),
        "runs",
    )
    return (
        placed.join(runs, [*keys, "_part"])
        .withColumn(rank_col, F.col("_pos") - F.col("_first") + F.col("_before"))
        .drop("_part", "_pos", "_first", "_before")
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, id_col: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated percentiles of an unbounded set, one column per entry of ``probs``.

    Works from distributed ranks, so no task ever holds a whole group.  For values with a small
    domain (16-bit pixels) aggregate counts first and use ``percentile(value, p, count)`` instead.
    """
    r = ranked(df.select(*keys, value, id_col), keys, [value, id_col], "_rank")
    sizes = materialise(r.groupBy(*keys).agg(F.count("*").alias("_n")), "sizes")
    if keys:
        r = r.join(sizes, keys)
    else:
        r = r.withColumn("_n", sizes.scalar())
    aggs = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        low = F.max(F.when(F.col("_rank") == lo, F.col(value)))
        high = F.max(F.when(F.col("_rank") == hi, F.col(value)))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return r.groupBy(*keys).agg(*aggs)


def first_by_hash(df: DataFrame, keys: list[str], quota: DataFrame, hash01: Column, ids: list[str]) -> DataFrame:
    """Per key, the ``quota`` rows with the smallest hash (in [0, 1)), ties by ``ids``.

    ``quota(keys…, quota, size)`` gives the wanted and the present rows of each key.  A threshold a few
    deviations above the wanted share drops nearly everything before any sort; keys where too few rows
    survive it, if any, are ranked in full, so the result is always exact.
    """
    q = materialise(quota, "quota")
    placed = df.withColumn("_h", hash01)
    placed = placed.join(q, keys) if keys else placed.select("*", *[one_row(q)[c].alias(c) for c in ("quota", "size")])
    share = (F.col("quota") + 6 * F.sqrt(F.col("quota").cast("double")) + 50) / F.col("size")
    near = materialise(placed.filter(F.col("_h") < share), "near")

    def take(rows: DataFrame) -> DataFrame:
        return ranked(rows, keys, ["_h", *ids], "_r").filter(F.col("_r") < F.col("quota")).select(*df.columns)

    want = F.least("quota", "size")
    if keys:
        have = near.groupBy(*keys).agg(F.count("*").alias("_have"))
        short = materialise(q.join(have, keys, "left").filter(F.coalesce("_have", F.lit(0)) < want).select(*keys), "short")
        if short.isEmpty():
            return take(near)
        return take(near.join(short, keys, "left_anti")).unionByName(take(placed.join(short, keys, "left_semi")))
    enough = q.filter(want > near.count()).isEmpty()
    return take(near if enough else placed)
