"""Cluster hierarchy operators on given labels, and cluster × channel profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.functions.text import fixed_text
from tesselar.scale import materialise, ranked

MARKERS = 6


def level_columns(df: DataFrame) -> list[str]:
    return [f"cluster_L{i}" for i in range(schemas.LEVELS) if f"cluster_L{i}" in df.columns]


def unpivot_levels(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Wide labels to ``(keep…, level, cluster)``; ``clustering`` serves as level 0 when no level exists."""
    cols = level_columns(cells)
    pairs = [(int(c[-1]), c) for c in cols] or [(0, "clustering")]
    entries = F.array(*[F.struct(F.lit(i).alias("level"), scalars.safe_int(F.col(c)).alias("cluster")) for i, c in pairs])
    return (
        cells.select(*keep, F.explode(entries).alias("_l"))
        .select(*keep, F.col("_l.level").alias("level"), F.col("_l.cluster").alias("cluster"))
        .filter("cluster is not null")
    )


def cluster_channel_means(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean pixel value per (level, cluster, channel).

    Pixels collapse to one sum per (id, channel) before they meet the labels, so all levels share
    one pass over the pixels and the six-fold level expansion only touches small rows.
    """
    per_cell = pixels.groupBy("id", "channel").agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    labels = level_columns(cells) or ["clustering"]
    wide = per_cell.join(cells.select("id", *labels), "id")
    return (
        unpivot_levels(wide, ["channel", "s", "c"])
        .groupBy("level", "cluster", "channel")
        .agg((F.sum("s") / F.sum("c")).alias("avg"))
    )


def wide_averages(averages: DataFrame, channel_names: dict[int, str]) -> DataFrame:
    """One row per cluster with a column per channel name."""
    return (
        averages.groupBy(F.col("level").alias("level_id"), F.col("cluster").alias("cluster_id"))
        .pivot("channel", list(channel_names))
        .agg(F.first("avg"))
        .select("level_id", "cluster_id", *[F.col(f"`{c}`").alias(n) for c, n in channel_names.items()])
    )


def cluster_context(levels: DataFrame, cells: DataFrame) -> DataFrame:
    """Size, share of all cells and projection centre per (level, cluster)."""
    total = cells.agg(F.count("*")).scalar()
    return levels.groupBy("level", "cluster").agg(
        F.count("*").alias("n"),
        F.avg("umap2_x").alias("center_x"),
        F.avg("umap2_y").alias("center_y"),
    ).withColumn("percent", F.col("n") / total * 100.0)


def marker_scores(averages: DataFrame) -> DataFrame:
    """z-score of every cluster mean within its level and channel; NULL when the level has one cluster."""
    w = Window.partitionBy("level", "channel")
    sd = F.stddev_samp("avg").over(w)
    return averages.withColumn("z", (F.col("avg") - F.avg("avg").over(w)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))


def markers(scores: DataFrame, k: int = MARKERS) -> DataFrame:
    """The k highest and k lowest channels per cluster with their text, NULL z last."""
    order = Window.partitionBy("level", "cluster").orderBy(F.desc_nulls_last(F.round("z", 9)), "channel")
    size = Window.partitionBy("level", "cluster")
    placed = scores.withColumn("place", F.row_number().over(order)).withColumn("_n", F.count("*").over(size))
    name = F.col("channel_name") if "channel_name" in scores.columns else F.col("channel").cast("string")
    text = F.concat(name, F.lit(":"), F.coalesce(fixed_text("z", 2), F.lit("nan")), F.lit("σ"))
    return placed.select(
        "level", "cluster", "channel", "avg", "z", "place",
        (F.col("place") <= k).cast("int").alias("is_high"), (F.col("place") > F.col("_n") - k).cast("int").alias("is_low"),
        text.alias("text"),
    )


def centroid_distances(levels: DataFrame, dims: list[str]) -> DataFrame:
    """Distance of every cell to the mean of its cluster; the means are few and measured before joining."""
    means = materialise(
        levels.groupBy("level", "cluster").agg(*[F.avg(d).alias(f"_c{i}") for i, d in enumerate(dims)]), "means"
    )
    sq = sum(((F.col(d) - F.col(f"_c{i}")) * (F.col(d) - F.col(f"_c{i}")) for i, d in enumerate(dims)), F.lit(0.0))
    return levels.join(means, ["level", "cluster"]).withColumn("distance", F.round(F.sqrt(sq), 9)).drop(*[f"_c{i}" for i in range(len(dims))])


def ranks_within_clusters(levels: DataFrame, dims: list[str]) -> DataFrame:
    """0-based rank by distance to the cluster mean, ties by id.  Level 0 is one cluster of all cells,
    so the rank is computed from range partitions, never in one task."""
    return ranked(centroid_distances(levels, dims), ["level", "cluster"], ["distance", "id"], "rank")


def cluster_parents(cells: DataFrame, level_k: dict[int, int] | None = None) -> DataFrame:
    """Majority cluster of the level above; ties go to the parent seen first, i.e. with the lowest id.

    With ``level_k`` every expected cluster appears, an empty one with parent −1.
    """
    cols = level_columns(cells)
    pairs = [(int(c[-1]), c, p) for p, c in zip(cols, cols[1:])]
    entries = F.array(*[
        F.struct(F.lit(i).alias("level"), scalars.safe_int(F.col(c)).alias("cluster"), scalars.safe_int(F.col(p)).alias("parent"))
        for i, c, p in pairs
    ])
    votes = (
        cells.select("id", F.explode(entries).alias("v"))
        .groupBy("v.level", "v.cluster", "v.parent")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .filter("cluster is not null and parent is not null")
    )
    won = votes.groupBy("level", "cluster").agg(F.max_by("parent", F.struct("n", -F.col("first_id"))).alias("parent_cluster"))
    root = cells.select(F.lit(int(cols[0][-1])).alias("level"), scalars.safe_int(F.col(cols[0])).alias("cluster")).distinct().filter("cluster is not null")
    out = won.select("level", "cluster", (F.col("level") - 1).alias("parent_level"), "parent_cluster").unionByName(
        root.select("level", "cluster", F.lit(-1).alias("parent_level"), F.lit(-1).cast("bigint").alias("parent_cluster"))
    )
    if level_k is None:
        return out
    rows = [(lvl, c) for lvl, k in level_k.items() for c in range(k)]
    wanted = cells.sparkSession.createDataFrame(rows, "level int, cluster bigint")
    return wanted.join(out, ["level", "cluster"], "left").select(
        "level", "cluster",
        F.coalesce("parent_level", F.col("level") - 1).alias("parent_level"),
        F.coalesce("parent_cluster", F.lit(-1).cast("bigint")).alias("parent_cluster"),
    )


def children_of(parents: DataFrame) -> DataFrame:
    """Sorted child list per cluster (a cluster has at most as many children as the next level has clusters)."""
    return (
        parents.filter("parent_cluster >= 0")
        .groupBy(F.col("parent_level").alias("level"), F.col("parent_cluster").alias("cluster"))
        .agg(F.sort_array(F.collect_set("cluster")).alias("children"))
    )


def cluster_summary(ranks: DataFrame, parents: DataFrame, coordinates: list[str]) -> DataFrame:
    """Hierarchy table: size, representative (rank 0), its coordinates, parent and children."""
    sizes = ranks.groupBy("level", "cluster").agg(F.count("*").alias("size"))
    rep = ranks.filter("rank = 0").select(
        "level", "cluster", F.col("id").alias("rep_index"), *[F.col(c).alias(f"rep_{c}") for c in coordinates]
    )
    return (
        sizes.join(rep, ["level", "cluster"])
        .join(parents, ["level", "cluster"], "left")
        .join(children_of(parents), ["level", "cluster"], "left")
        .select(
            "level", F.col("cluster").alias("cluster_id"), "size", "rep_index", "parent_level",
            F.col("parent_cluster").alias("parent_cluster_id"),
            F.coalesce("children", F.array().cast("array<bigint>")).alias("children_cluster_ids"),
            *[f"rep_{c}" for c in coordinates],
        )
    )


def hierarchy_export(summary: DataFrame) -> DataFrame:
    """CSV form: children as ``"1,2"``."""
    return summary.withColumn("children_cluster_ids", F.array_join("children_cluster_ids", ","))


def preview_points(levels: DataFrame, label_fallback: Column | None = None) -> DataFrame:
    """The best-ranked cell of every cluster at the preview levels (all but the finest)."""
    return (
        levels.filter(F.col("level") < schemas.LEVELS - 1)
        .groupBy("level", "cluster")
        .agg(F.min(F.struct("rank", "id")).alias("_m"))
        .select("level", "cluster", F.col("_m.id").alias("id"), F.col("_m.rank").alias("rank"))
    )


def dominant_annotation(cells: DataFrame, annotations: DataFrame, kinds: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Most frequent non-blank annotation per (level, cluster, kind); ties go to the one seen first.

    ``annotations(id, kinds…)``; with ``ids`` only those cells vote.
    """
    pool = cells if ids is None else cells.join(ids.select("id").distinct(), "id", "left_semi")
    known = annotations.select("id", *[F.trim(F.col(k).cast("string")).alias(k) for k in kinds])
    joined = pool.join(known, "id")
    # Collapse identical label/annotation combinations before the level × kind expansion.
    labels = level_columns(cells) or ["clustering"]
    combos = joined.groupBy(*labels, *kinds).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])).alias("_k")
    votes = (
        unpivot_levels(combos, [*kinds, "n", "first_id"])
        .select("level", "cluster", "n", "first_id", each)
        .filter("_k.value is not null and _k.value <> '' and lower(_k.value) <> 'nan'")
        .groupBy("level", "cluster", "_k.kind", "_k.value")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )
    return votes.groupBy("level", "cluster", "kind").agg(
        F.max_by("value", F.struct("n", -F.col("first_id"))).alias("value"), F.max("n").alias("n")
    )
