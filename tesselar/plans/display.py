"""Dataset build and the visible-set plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.operators import detail, intensity, selection
from tesselar.scale import materialise


def coordinates(cells: DataFrame, subset: DataFrame | None, per_chunk: int = 1, zero_as_missing: bool = True) -> DataFrame:
    """Nested coordinate records of the displayed cells with their chunk address.

    ``subset(id, position)``; without one every cell is shown at its own id.  A missing projection
    falls back to the tissue position.
    """
    x, y = F.coalesce("X_centroid", F.lit(0.0)), F.coalesce("Y_centroid", F.lit(0.0))
    col = lambda c, other: F.coalesce(c, other) if c in cells.columns else other
    extra = [scalars.safe_int(F.col(c)).alias(c) for i in range(schemas.LEVELS) for c in (f"rank_L{i}", f"cluster_L{i}") if c in cells.columns]
    rows = cells.withColumn("position", F.col("id")) if subset is None else cells.join(subset, "id")
    return rows.select(
        "id",
        scalars.chunk_id(F.col("position"), per_chunk).alias("chunk_id"),
        scalars.local_index(F.col("position"), per_chunk).alias("local_index"),
        F.struct(x.alias("x"), y.alias("y")).alias("raw"),
        F.struct(col("umap2_x", x).alias("x"), col("umap2_y", y).alias("y")).alias("umap2d"),
        F.struct(col("umap3_x", x).alias("x"), col("umap3_y", y).alias("y"), col("umap3_z", F.lit(0.0)).alias("z")).alias("umap3d"),
        scalars.resolve_label(cells.columns, zero_as_missing=zero_as_missing).alias("label"),
        *extra,
    )


def spatial_coordinates(cells: DataFrame) -> DataFrame:
    """Coordinate records of every cell, without address or label."""
    return coordinates(cells, None).select("id", "raw", "umap2d", "umap3d")


def first_coordinates(cells: DataFrame, subset: DataFrame, per_chunk: int, limit: int | None) -> DataFrame:
    """Records of the first ``limit`` display positions."""
    shown = subset if limit is None else subset.filter(F.col("position") < limit)
    return coordinates(cells, shown, per_chunk)


def slot_geometry(positions: DataFrame, per_chunk: int, tile: int) -> DataFrame:
    """Atlas rectangle of every display position: pixel corner and UV bounds."""
    per = F.lit(per_chunk).cast("bigint")
    cols, rows = scalars.grid_columns(per), scalars.grid_rows(per)
    slot = scalars.local_index(F.col("position"), per_chunk)
    c, r = slot % cols, F.floor(slot / cols)
    return positions.select(
        "position", scalars.chunk_id(F.col("position"), per_chunk).alias("chunk_id"), slot.alias("local_index"),
        (c * tile).cast("bigint").alias("px"), (r * tile).cast("bigint").alias("py"),
        (c / cols).alias("u0"), (r / rows).alias("v0"), ((c + 1) / cols).alias("u1"), ((r + 1) / rows).alias("v1"),
    )


def display_address(points: DataFrame, shown: DataFrame) -> DataFrame:
    """Chunk address of the displayed row of each point; a point that is not displayed keeps its own."""
    d = shown.select("id", F.col("chunk_id").alias("_c"), F.col("local_index").alias("_l"))
    return points.join(d, "id", "left").withColumns(
        {"chunk_id": F.coalesce("_c", "chunk_id"), "local_index": F.coalesce("_l", "local_index")}
    ).drop("_c", "_l")


def visible_set(
    points: DataFrame,
    pixels: DataFrame,
    params: DataFrame,
    n_channels: int,
    radius: float,
    level: int,
    lod: float = 1.0,
    pins: DataFrame | None = None,
    signals_ready: bool = True,
) -> DataFrame:
    """Score → drop empty tiles → suppress overlaps → budget sample → add pins, as an id list."""
    scores = None
    if signals_ready and n_channels:
        scores = intensity.signal_filter(intensity.composite_scores(intensity.tile_signal(pixels), params, n_channels))
    items = materialise(detail.scored_items(points, scores), "items")
    kept = materialise(detail.suppress_overlaps(items, radius), "kept")
    shown = detail.budget_sample(kept, level, lod)
    return shown if pins is None else selection.with_pins(shown, points.select("id"), pins)
