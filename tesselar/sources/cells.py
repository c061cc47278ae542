"""Cell, feature and tile-stack scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars, vectors
from tesselar.scale import ranked

TILES_PER_FILE = 1 << 16
ROW_GROUP_BYTES = 16 * 1024 * 1024


def with_row_ids(scan: DataFrame) -> DataFrame:
    """Number the rows of a file scan 0..n-1 in file order (path, block, line)."""
    placed = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return ranked(placed, [], ["_file", "_block", "_line"], "id").drop("_file", "_block", "_line")


def conform_cells(df: DataFrame) -> DataFrame:
    """Known columns cast to their types (names matched without case), others kept as they are."""
    known = {k.lower(): (k, t) for k, t in schemas.CELL_TYPES.items()}
    cols = []
    for c in df.columns:
        name, dtype = known.get(c.strip().lower(), (c, None))
        cols.append(F.col(f"`{c}`").try_cast(dtype).alias(name) if dtype else F.col(f"`{c}`"))
    return df.select(*cols)


def scan_cells(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Cell table from CSV or parquet; files without an ``id`` column get row numbers."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if "id" not in [c.lower() for c in raw.columns]:
        raw = with_row_ids(raw)
    return conform_cells(raw)


def scan_features(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(id, embedding)`` with non-finite entries set to 0."""
    df = spark.read.parquet(path).filter(F.col(vector_col).isNotNull())
    return df.select(F.col(id_col).cast("bigint").alias("id"), vectors.sanitise(F.col(vector_col)).alias("embedding"))


def feature_shape(features: DataFrame) -> DataFrame:
    """Row count and vector lengths; ``valid`` tells whether the matrix is rectangular."""
    size = F.size("embedding")
    return features.agg(
        F.count("*").alias("n"),
        F.min(size).cast("bigint").alias("min_dim"),
        F.max(size).cast("bigint").alias("max_dim"),
        F.coalesce(F.min(size) == F.max(size), F.lit(False)).cast("int").alias("valid"),
    )


def write_tiles(pixels: DataFrame, path: str, per_chunk: int, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Packed tile stack, one row per (channel, id), in files that follow each other by channel, chunk and id.

    A file covers a range and so does every row group in it, so a scan of some chunks skips the others by their statistics;
    the number of files follows from the bytes, not from the number of chunks.  A tile has a fixed pixel count (height ×
    width), so the packed array is bounded.
    """
    place = ["channel", "chunk_id", "id"]
    tiles = (
        pixels.withColumn("chunk_id", scalars.chunk_id(F.col("id"), per_chunk))
        # Ranges of the keys also serve the grouping, so pixels are shuffled once.
        .repartitionByRange(*place)
        .groupBy(*place)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("y", "x", "value"))), lambda p: p["value"].cast("int")
            ).alias("pixels")
        )
        .sortWithinPartitions(*place)
    )
    tiles.write.option("maxRecordsPerFile", TILES_PER_FILE).option("parquet.block.size", row_group_bytes).parquet(path)


def packed_tiles(spark: SparkSession, path: str, channels=None, chunks=None) -> DataFrame:
    """``(channel, chunk_id, id, pixels)``; row groups without a listed channel and chunk are not read."""
    t = spark.read.parquet(path)
    if channels is not None:
        t = t.filter(F.col("channel").isin(list(channels)))
    if chunks is not None:
        t = t.filter(F.col("chunk_id").isin(list(chunks)))
    return t.select("channel", "chunk_id", "id", "pixels")


def scan_tiles(spark: SparkSession, path: str, width: int, channels=None, chunks=None) -> DataFrame:
    """Long pixel form ``(channel, id, y, x, value)`` of ``packed_tiles``."""
    t = packed_tiles(spark, path, channels, chunks)
    return t.select("channel", "id", "chunk_id", F.posexplode("pixels").alias("_i", "value")).select(
        "channel",
        "id",
        "chunk_id",
        F.floor(F.col("_i") / width).cast("int").alias("y"),
        (F.col("_i") % width).cast("int").alias("x"),
        F.col("value").cast("bigint").alias("value"),
    )


def dataset_meta(pixels: DataFrame, per_chunk: int, display: DataFrame | None = None) -> DataFrame:
    """Channel count, cell count, displayed count, chunk count and atlas grid in one row."""
    base = pixels.agg(
        F.count_distinct("channel").alias("n_channels"), (F.max("id") + 1).alias("n_cells")
    )
    if display is None:
        base = base.withColumn("n_display", F.col("n_cells"))
    else:
        base = base.withColumn("n_display", display.agg(F.count("*")).scalar())
    per = F.lit(per_chunk).cast("bigint")
    return base.select(
        "n_channels",
        "n_cells",
        "n_display",
        F.ceil(F.col("n_display") / per).cast("bigint").alias("n_chunks"),
        per.alias("n_per_chunk"),
        scalars.grid_columns(per).alias("grid_cols"),
        scalars.grid_rows(per).alias("grid_rows"),
    )
