"""Annotation composition and label/review views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import scalars


def annotation_keys(annotations: DataFrame, kinds=("celltype", "neigh_names")) -> DataFrame:
    """``(id, kind, key)`` with blanks removed and, for cell types, ``unknown`` too."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(F.col(k).cast("string")).alias("key")) for k in kinds]))
    return (
        annotations.select("id", each.alias("_k"))
        .select("id", "_k.kind", "_k.key")
        .filter("key is not null and key <> '' and not (kind = 'celltype' and lower(key) = 'unknown')")
    )


def _shares(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Adds each column's percentage of its kind; kinds are few, so their totals are one small map."""
    sums = counts.groupBy("kind").agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("sums"))
    total = sums.agg(F.map_from_entries(F.collect_list(F.struct("kind", "sums")))).scalar()[F.col("kind")]
    pct = {
        f"{c}_pct": F.when(total[c] > 0, F.col(c) / F.nullif(total[c], F.lit(0)) * 100.0).otherwise(F.lit(0.0)) for c in columns
    }
    return counts.withColumns(pct)


def composition(annotations: DataFrame, selection: DataFrame) -> DataFrame:
    """Counts and shares per annotation key, over everything and over a selection."""
    sel = selection.select("id").distinct().withColumn("_in", F.lit(1))
    counts = annotation_keys(annotations).join(sel, "id", "left").groupBy("kind", "key").agg(
        F.count("*").alias("everything"), F.count("_in").alias("selected")
    )
    return _shares(counts, ["everything", "selected"])


def region_composition(annotations: DataFrame, regions: DataFrame) -> DataFrame:
    """Counts and shares for two regions; only keys present in a region appear and totals use those keys."""
    flags = regions.groupBy("id").agg(
        F.max((F.col("region") == 0).cast("int")).alias("_r1"), F.max((F.col("region") == 1).cast("int")).alias("_r2")
    )
    counts = (
        annotation_keys(annotations).join(flags, "id", "left").groupBy("kind", "key").agg(
            F.count("*").alias("everything"),
            F.coalesce(F.sum("_r1"), F.lit(0)).cast("bigint").alias("region1"),
            F.coalesce(F.sum("_r2"), F.lit(0)).cast("bigint").alias("region2"),
        ).filter("region1 > 0 or region2 > 0")
    )
    return _shares(counts, ["everything", "region1", "region2"])


def valid_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (scores coerced) and rejected rows of incoming reviews."""
    ok = (
        F.col("status").isin(*scalars.REVIEW_STATUSES)
        & F.col("level").isNotNull()
        & F.col("cluster_id").isNotNull()
        & (F.trim(F.coalesce(F.col("model"), F.lit(""))) != "")
    )
    ok = F.coalesce(ok, F.lit(False))
    good = reviews.filter(ok).withColumns(
        {"llm_accuracy": scalars.review_score(F.col("llm_accuracy")), "confidence": scalars.review_score(F.col("confidence"))}
    )
    return good, reviews.filter(~ok)


def latest_reviews(reviews: DataFrame, tie: str | None = None) -> DataFrame:
    """Last review per (level, cluster, model)."""
    keys = ["level", "cluster_id", "model"]
    rest = [c for c in reviews.columns if c not in keys]
    order = F.struct("reviewed_at", tie) if tie else F.col("reviewed_at")
    return reviews.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def normalised_status(status: Column, user_title: Column) -> Column:
    """An accepted review that carries a user title is a correction."""
    return F.when((status == "accepted") & (F.trim(F.coalesce(user_title, F.lit(""))) != ""), F.lit("corrected")).otherwise(status)


def review_display(titles: DataFrame) -> DataFrame:
    """Displayed title and flags of ``(title, status, user_title)`` rows, status NULL when unreviewed."""
    s = normalised_status(F.col("status"), F.col("user_title"))
    s = F.when(s.isin(*scalars.REVIEW_STATUSES), s)
    own = F.nullif(F.col("user_title"), F.lit(""))
    return titles.withColumns(
        {
            "display_status": s,
            "display_title": F.when(s == "corrected", F.coalesce(own, F.col("title"))).otherwise(F.coalesce("title", F.lit(""))),
            "strikethrough": F.coalesce((s == "rejected").cast("int"), F.lit(0)),
            "is_confirmed": F.coalesce(s.isin("accepted", "corrected").cast("int"), F.lit(0)),
        }
    )


def core_labels(rows: DataFrame, fields: list[str], width: float | None, height: float | None, flip_height: float | None = None) -> DataFrame:
    """Text labels of core-metadata rows placed in image space; rows without text drop.

    Positions stay as they are when they fit the image (4 % margin), otherwise they are scaled
    uniformly into it.
    """
    lines = F.filter(F.array(*[F.element_at("values", F.lit(f)) for f in fields]), lambda v: v.isNotNull() & (v != ""))
    x, y = F.col("x"), F.col("y")
    if width and height and width > 0 and height > 0:
        box = rows.agg(
            F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).alias("b")
        ).scalar()
        m = scalars.FIT_MARGIN
        fits = (
            (box["x1"] <= width * (1 + m)) & (box["x0"] >= -width * m)
            & (box["y1"] <= height * (1 + m)) & (box["y0"] >= -height * m)
        )
        keep = (box["x1"] <= 0) | (box["y1"] <= 0) | fits
        scale = F.least(
            F.lit(width * (1 - 2 * m)) / F.greatest(F.lit(1.0), box["x1"] - box["x0"]),
            F.lit(height * (1 - 2 * m)) / F.greatest(F.lit(1.0), box["y1"] - box["y0"]),
        )
        x = F.when(keep, x).otherwise(x * scale + (width * m - box["x0"] * scale))
        y = F.when(keep, y).otherwise(y * scale + (height * m - box["y0"] * scale))
    placed = rows.select("id", x.alias("x"), y.alias("y"), lines.alias("_lines")).filter(F.size("_lines") > 0)
    return placed.select(
        "id", "x", "y", scalars.flip_y(F.col("y"), flip_height).alias("world_y"), F.array_join("_lines", "\n").alias("text")
    )
