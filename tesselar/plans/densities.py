"""Intensity distributions: values and density curves, global, per selection, per region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import vectors
from tesselar.operators import groups, histograms, intensity
from tesselar.scale import materialise


def intensity_values(pixels: DataFrame, percentile: float = 99.0, factor: float = 0.1, max_samples: int | None = None) -> DataFrame:
    """Foreground value counts per channel; exact unless ``max_samples`` asks for a sample."""
    px = pixels if max_samples is None else intensity.proportional_sample(pixels, ["channel"], max_samples)
    return intensity.foreground(materialise(intensity.value_counts(px, ["channel"]), "counts"), ["channel"], percentile, factor)


def pixel_density(pixels: DataFrame, grid: int = 256, percentile: float = 99.0, factor: float = 0.1, max_samples: int | None = None) -> DataFrame:
    """Density curve per channel over foreground pixels."""
    counts = materialise(intensity_values(pixels, percentile, factor, max_samples), "foreground")
    return histograms.kde(counts, ["channel"], grid)


def cell_density(pixels: DataFrame, regions: DataFrame, grid: int = 192, stat: str = "p95") -> DataFrame:
    """Density curve per (region, channel) over one summary value per cell."""
    wanted = regions.select("id").distinct()
    per_cell = intensity.cell_intensity(pixels.join(wanted, "id", "left_semi"), stat)
    counts = per_cell.join(regions.select("region", "id").distinct(), "id").groupBy("region", "channel", "value").agg(F.count("*").alias("n"))
    return histograms.kde(materialise(counts, "cells"), ["region", "channel"], grid)


def last_two_regions(regions: DataFrame) -> DataFrame:
    """The two highest-numbered non-empty regions, renumbered 0 and 1."""
    b = regions.agg(F.max("region")).scalar()
    a = regions.filter(F.col("region") < b).agg(F.max("region")).scalar()
    return regions.filter((F.col("region") == a) | (F.col("region") == b)).select(
        F.when(F.col("region") == b, F.lit(1)).otherwise(F.lit(0)).alias("region"), "id"
    )


def compare_regions(pixels: DataFrame, features: DataFrame, regions: DataFrame, grid: int = 192, metric: str = "cosine_centered") -> DataFrame:
    """Density curves of the last two non-empty regions, each row with its region's size, compactness and representative."""
    two = last_two_regions(regions)
    rep = vectors.representation(features, metric)
    reg = two.select(F.col("region").cast("bigint").alias("group"), "id")
    reps = groups.region_representatives(rep, reg, reg.select("group").distinct()).withColumnRenamed("group", "region")
    return cell_density(pixels, two, grid).join(materialise(reps, "representatives"), "region", "left")
