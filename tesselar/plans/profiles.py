"""Hierarchy job, cluster profiles, prompts, labels and annotated label views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import text
from tesselar.operators import clusters, composition, kmeans, outlines
from tesselar.scale import materialise


def hierarchy(cells: DataFrame, space: str = "umap2", level_k: dict[int, int] | None = None, restarts: int | None = None, fit: bool = True):
    """``(labelled cells with ranks, hierarchy table)``; ``fit=False`` keeps the labels already present."""
    dims = kmeans.space_columns(cells, space)
    if fit:
        cells = materialise(kmeans.multilevel_kmeans(cells, space, level_k, restarts or kmeans.RESTARTS), "labelled")
    coords = [c for c in schemas.COORDINATES if c in cells.columns]
    levels = clusters.unpivot_levels(cells, ["id", *coords])
    ranks = clusters.ranks_within_clusters(levels, dims)
    summary = clusters.cluster_summary(ranks, clusters.cluster_parents(cells), coords)
    wide = ranks.groupBy("id").pivot("level", list(range(schemas.LEVELS))).agg(F.first("rank"))
    wide = wide.select("id", *[F.col(str(i)).alias(f"rank_L{i}") for i in range(schemas.LEVELS)])
    old = [c for c in cells.columns if c.startswith("rank_L")]
    return cells.drop(*old).join(wide, "id"), summary


def cluster_profile(pixels: DataFrame, cells: DataFrame, channels: DataFrame, only_levels: list[int] | None = None) -> DataFrame:
    """Cluster × channel means with z-scores and names; raises when no requested level exists."""
    means = materialise(clusters.cluster_channel_means(pixels, cells), "profile")
    if only_levels:
        means = means.filter(F.col("level").isin(only_levels))
        if means.isEmpty():
            raise ValueError("no clusters found for the requested levels")
    names = channels.select(F.col("zarr_c").alias("channel"), F.col("name").alias("channel_name"))
    return clusters.marker_scores(means.join(names, "channel"))


def cluster_prompts(profile: DataFrame, context: DataFrame, k: int = clusters.MARKERS) -> DataFrame:
    """One prompt per (level, cluster).  A cluster has one row per channel, so its lists are short."""
    m = clusters.markers(profile, k)
    listing = lambda cond, sep, item, key: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(key, item.alias("t"))))), lambda s: s["t"]), sep
    )
    high, low, every = F.col("is_high") == 1, F.col("is_low") == 1, F.lit(True)
    named = profile.select("level", "cluster", "channel", "channel_name")
    pairs = m.join(named, ["level", "cluster", "channel"]).withColumn("_pair", F.concat_ws("=", "channel_name", text.fixed_text("avg", 4)))
    body = pairs.groupBy("level", "cluster").agg(
        listing(high, ", ", F.col("text"), F.col("place")).alias("top"),
        listing(low, ", ", F.col("text"), F.col("place")).alias("low"),
        listing(every, ", ", F.col("channel_name"), F.col("channel")).alias("channels"),
        listing(every, "; ", F.col("_pair"), F.col("channel")).alias("averages"),
    )
    # Wording of the context lines.
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- number of cells: "), F.col("n").cast("string")),
        F.concat(F.lit("- percentage: "), text.fixed_text("percent", 2), F.lit("%")),
        F.when(F.col("center_x").isNotNull(), F.concat(F.lit("- UMAP centroid: ("), text.fixed_text("center_x", 2), F.lit(", "), text.fixed_text("center_y", 2), F.lit(")"))),
    )
    ctx = context.select("level", "cluster", lines.alias("context"))
    return body.join(ctx, ["level", "cluster"], "left").select(
        "level", "cluster",
        text.prompt(F.col("level"), F.col("cluster"), F.col("top"), F.col("low"), F.col("channels"), F.col("averages"), F.col("context")).alias("prompt"),
    )


def labels_from_responses(responses: DataFrame) -> DataFrame:
    """Parsed titles of ``responses(level, cluster_id, model, text)``; ``needs_retry`` marks weak answers."""
    return responses.withColumn("_f", text.response_fields(F.col("text"))).select("level", "cluster_id", "model", "_f.*")


def label_view(points: DataFrame, labels: DataFrame, dominant: DataFrame, reviews: DataFrame, level: int, model: str, flip_height: float | None = None) -> DataFrame:
    """Annotated outlines of one level: centre, title, dominant annotations, review status.

    ``points(label, x, y)``; only outlined clusters with a non-empty title appear.
    """
    outline = outlines.cluster_outlines(points)
    titled = labels.filter((F.col("level") == level) & (F.col("model") == model) & (F.coalesce("title", F.lit("")) != "")).select(
        F.col("cluster_id").cast("bigint").alias("label"), "title", F.coalesce("description", F.lit("")).alias("description")
    )
    kinds = dominant.filter(F.col("level") == level).groupBy(F.col("cluster").alias("label")).agg(
        F.max(F.when(F.col("kind") == "celltype", F.col("value"))).alias("dominant_celltype"),
        F.max(F.when(F.col("kind") == "neigh_names", F.col("value"))).alias("dominant_neigh_names"),
    )
    verdict = reviews.filter((F.col("level") == level) & (F.col("model") == model)).select(
        F.col("cluster_id").cast("bigint").alias("label"), "status", "user_title"
    )
    y = F.col("center_y") if flip_height is None else F.lit(float(flip_height)) - F.col("center_y")
    joined = outline.join(titled, "label").join(kinds, "label", "left").join(verdict, "label", "left")
    return composition.review_display(joined.withColumn("center_y", y))
