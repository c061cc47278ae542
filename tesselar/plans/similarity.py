"""Single-cell, group and region analyses in embedding space."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import vectors
from tesselar.operators import groups, neighbours
from tesselar.scale import materialise


def single_cell(
    features: DataFrame,
    cells: DataFrame,
    query_ids: DataFrame,
    k: int = neighbours.GALLERY_K,
    metric: str = "cosine",
    space: str = "umap",
    allowed: DataFrame | None = None,
    sample_size: int = neighbours.REFERENCE_QUERIES,
) -> DataFrame:
    """One row per (query, neighbour): similarity, rank, coordinates, and the query's compactness and
    difference with their percentiles among sampled queries.  Any number of queries runs as one plan."""
    near = materialise(neighbours.neighbours_of(features, cells, query_ids, k, metric, space, allowed), "near")
    local = neighbours.local_structure(near, features)
    ref = neighbours.percentile_reference(features, cells, k, metric, space, sample_size, allowed)
    stats = neighbours.percentile_columns(local, ref, ["compactness", "difference"])
    return neighbours.coordinates_for(near, cells).join(stats, "query")


class GroupAnalysis:
    """Analysis of many id groups ``(group, id)`` at once; each part is planned when asked for.

    The group difference compares the centroid of the metric's space with the plain cosine centre
    unless ``consistent_space`` asks for both in the metric's space.
    """

    def __init__(
        self,
        features: DataFrame,
        cells: DataFrame,
        group_ids: DataFrame,
        metric: str = "cosine_centered",
        consistent_space: bool = False,
        distinct: bool = True,
    ):
        self.features, self.cells, self.group_ids = features, cells, group_ids
        self.consistent_space, self.distinct = consistent_space, distinct
        self.rep = vectors.representation(features, metric)

    @cached_property
    def _centroids(self) -> DataFrame:
        return groups.centroids(groups.members(self.rep, self.group_ids, self.distinct))

    @cached_property
    def _scores(self) -> DataFrame:
        return groups.member_scores(groups.members(self.rep, self.group_ids, self.distinct), self._centroids)

    def summary(self) -> DataFrame:
        """Size, compactness, representative, difference to the whole and its percentile per group."""
        base = self.rep.select("id", F.col("vec").alias("embedding")) if self.consistent_space else self.features
        diff = materialise(groups.group_difference(self._centroids, base), "difference")
        at_most = neighbours.fraction_at_most(
            diff.select(F.col("group").cast("bigint").alias("key"), F.col("difference").alias("value")), groups.centre_distances(base)
        ).select(F.col("key").alias("group"), F.col("fraction").alias("difference_percentile"))
        return groups.representatives(self._scores).join(diff, "group").join(at_most, "group")

    def members(self) -> DataFrame:
        """Distance, similarity and first-axis projection per member."""
        return self._scores.select("group", "id", "distance", "similarity").join(groups.first_axis_projection(self._scores), ["group", "id"])

    def exemplars(self) -> DataFrame:
        return groups.exemplars(self._scores)

    def histogram(self) -> DataFrame:
        """All rows against each centroid."""
        return groups.centroid_histogram(self.rep, self._centroids)

    def centre_histogram(self) -> DataFrame:
        """All rows against the global centre."""
        return groups.centre_histogram(self.rep, self.features)

    def medians(self) -> DataFrame:
        return groups.similarity_medians(self.rep, self._scores, self._centroids)

    def projection_centre(self) -> DataFrame:
        return (
            self.group_ids.join(self.cells.select("id", "umap2_x", "umap2_y"), "id")
            .groupBy("group").agg(F.avg("umap2_x").alias("center_x"), F.avg("umap2_y").alias("center_y"))
        )
