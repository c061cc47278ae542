"""Group and region analysis in embedding space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tesselar.functions import scalars, vectors
from tesselar.functions.vectors import list_column, matrix, unit_rows
from tesselar.operators.histograms import HELD_BYTES, fixed_bins
from tesselar.operators.pairwise import SCORE_DECIMALS, add_counts, code_bins_kernel, codes_in_bins_kernel, histogram_kernel, pairwise
from tesselar.scale import numbers, exact_percentiles, materialise

EXEMPLARS = 6
CENTROID_BINS = 60
CENTRE_BINS = 40
COARSE_BITS = 16  # of a score's 31: counted in the second pass only


def members(rep: DataFrame, groups: DataFrame, distinct: bool = True) -> DataFrame:
    """``(group, id, vec)``: ids outside the table drop; repeats drop unless ``distinct=False``."""
    g = groups.select("group", "id")
    return (g.distinct() if distinct else g).join(rep, "id")


def centroids(group_members: DataFrame) -> DataFrame:
    """``(group, size, centroid, has_direction)`` with a unit centroid, or zeros when the mean is zero."""
    c = group_members.groupBy("group").agg(F.count("*").alias("size"), vectors.mean_vector(F.col("vec")).alias("m"))
    return materialise(
        c.select("group", "size", vectors.unit(F.col("m")).alias("centroid"),
                 F.exists("m", lambda x: x != 0).alias("has_direction")),
        "centroids",
    )


def member_scores(group_members: DataFrame, group_centroids: DataFrame) -> DataFrame:
    """Distance and similarity of every member to its group centroid."""
    return group_members.join(group_centroids, "group").select(
        "group", "id", "vec", "centroid", "has_direction",
        vectors.l2_distance("vec", "centroid").alias("distance"),
        scalars.clip(vectors.dot("vec", "centroid"), -1.0, 1.0).alias("similarity"),
    )


def representatives(scores: DataFrame) -> DataFrame:
    """Size, compactness and the member nearest to the centroid, per group."""
    key = F.struct(F.round("distance", 9), "id")
    return scores.groupBy("group").agg(
        F.count("*").alias("size"),
        F.avg("distance").alias("compactness"),
        F.min_by("id", key).alias("representative"),
        F.min_by(F.when(F.col("has_direction"), F.col("similarity")), key).alias("representative_similarity"),
    )


def region_representatives(rep: DataFrame, regions: DataFrame, region_list: DataFrame) -> DataFrame:
    """One row per entry of ``region_list(group)``; an empty region has size 0 and NULLs."""
    m = members(rep, regions)
    out = representatives(member_scores(m, centroids(m)))
    return region_list.join(out, "group", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))


def exemplars(scores: DataFrame, k: int = EXEMPLARS) -> DataFrame:
    """The k members most similar to their centroid (a limit per task precedes the shuffle)."""
    order = Window.partitionBy("group").orderBy(F.desc(F.round("similarity", 9)), "id")
    return scores.select("group", "id", "similarity").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def global_centre(features: DataFrame) -> np.ndarray:
    """The unit mean of the unit features (one vector, whatever the number of rows)."""
    mean = vectors.overall_mean(vectors.representation(features))
    return unit_rows(mean[None, :])[0]


def centre_distances(features: DataFrame) -> DataFrame:
    """``(id, value)``: 1 − cosine to the global centre."""
    units = vectors.representation(features)
    s = scalars.clip(vectors.dot_with("vec", global_centre(features)), -1.0, 1.0)
    return units.select("id", (1.0 - s).alias("value"))


def group_difference(group_centroids: DataFrame, features: DataFrame) -> DataFrame:
    """1 − cosine of the group centroid to the global centre of the plain cosine space."""
    s = scalars.clip(vectors.dot_with("centroid", global_centre(features)), -1.0, 1.0)
    return group_centroids.select("group", (1.0 - s).alias("difference"))


def centroid_histogram(rep: DataFrame, group_centroids: DataFrame, bins: int = CENTROID_BINS) -> DataFrame:
    """Counts of all rows by ``(similarity to the group centroid + 1) / 2``; every bin appears."""
    q = group_centroids.select(F.col("group").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    part = pairwise(q, rep, histogram_kernel(bins), "query bigint, bin bigint, n bigint")
    counts = part.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    slots = q.select(F.col("id").alias("query"), numbers(bins).alias("bin"))
    return slots.join(counts, ["query", "bin"], "left").select(
        F.col("query").alias("group"), "bin", ((F.col("bin") + 0.5) / bins).alias("center"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def centre_histogram(rep: DataFrame, features: DataFrame, bins: int = CENTRE_BINS) -> DataFrame:
    """Counts of all rows (no sample) by similarity of ``rep`` to the global centre."""
    y = scalars.similarity01(vectors.dot_with("vec", global_centre(features)))
    return fixed_bins(rep.select(F.round(y, 9).alias("v")), [], "v", bins)


def global_medians(rep: DataFrame, group_centroids: DataFrame) -> DataFrame:
    """``(group, global_median)`` of the similarity of all rows to each centroid, on the 0–1 scale.

    Scores are compared at nine decimals, so they are whole numbers in a known range.  One pass counts coarse bins, a
    second one counts the numbers inside the one or two bins that hold the middle; no row leaves a task.
    """
    q = group_centroids.select(F.col("group").cast("bigint").alias("id"), F.col("centroid").alias("vec"))
    schema = "query bigint, code bigint, n bigint"

    def positions(counts: DataFrame) -> DataFrame:
        """Adds the rows before each code and the places of the middle: the two are one for an odd number of rows."""
        before = Window.partitionBy("query").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def holding(place: str) -> Column:
        return F.max(F.when((F.col("before") <= F.col(place)) & (F.col(place) < F.col("before") + F.col("n")), F.col("code")))

    coarse = pairwise(q, rep, code_bins_kernel(COARSE_BITS), schema, combine=add_counts).groupBy("query", "code").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("query")
    middle = {"low": F.expr("(total - 1) div 2"), "high": F.expr("total div 2")}
    at = positions(coarse).withColumn("total", F.sum("n").over(whole)).withColumns(middle)
    bins = materialise(
        at.groupBy("query", "low", "high").agg(
            holding("low").alias("low_bin"), holding("high").alias("high_bin"),
            F.max(F.when((F.col("before") <= F.col("low")), F.col("before"))).alias("low_before"),
            F.max(F.when((F.col("before") <= F.col("high")), F.col("before"))).alias("high_before"),
        ), "bins",
    )
    fine_q = q.join(bins, q["id"] == bins["query"]).select(
        "id", F.concat("vec", F.array(F.col("low_bin").cast("double"), F.col("high_bin").cast("double"))).alias("vec"),
    )
    fine = pairwise(fine_q, rep, codes_in_bins_kernel(COARSE_BITS), schema, combine=add_counts).groupBy("query", "code").agg(F.sum("n").alias("n"))
    # Places are counted inside a bin; low and high may lie in different ones.
    fine = fine.join(bins, "query").withColumn("bin", F.shiftright("code", COARSE_BITS))
    inside = Window.partitionBy("query", "bin").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = lambda side: (
        (F.col("bin") == F.col(f"{side}_bin")) & (F.col(f"{side}_before") + F.col("before") <= F.col(side))
        & (F.col(side) < F.col(f"{side}_before") + F.col("before") + F.col("n"))
    )
    scale = 10**SCORE_DECIMALS
    y = scalars.similarity01((F.col("code") - scale) / F.lit(float(scale)))
    value = lambda side: F.max(F.when(here(side), y))
    return fine.groupBy(F.col("query").alias("group")).agg(((value("low") + value("high")) / 2).alias("global_median"))


def similarity_medians(rep: DataFrame, scores: DataFrame, group_centroids: DataFrame) -> DataFrame:
    """Median of y for the group members and for all rows."""
    own = exact_percentiles(
        scores.select("group", "id", scalars.similarity01(F.round("similarity", 9)).alias("y")),
        ["group"], "y", "id", {"group_median": 0.5},
    )
    return own.join(global_medians(rep, group_centroids), "group")


@arrow_udf(T.ArrayType(T.DoubleType()))
def _leading_axis(gram: pa.Array) -> pa.Array:
    flat = matrix(gram)
    d = int(round(flat.shape[1] ** 0.5))
    _, vec = np.linalg.eigh(flat.reshape(-1, d, d))
    axis = vec[:, :, -1]
    lead = np.take_along_axis(axis, np.abs(axis).argmax(axis=1)[:, None], axis=1)
    return list_column(axis * np.where(lead < 0, -1.0, 1.0))


@arrow_udf(T.DoubleType())
def _project(v: pa.Array, c: pa.Array, axis: pa.Array) -> pa.Array:
    return pa.array(np.einsum("nd,nd->n", matrix(v) - matrix(c), matrix(axis)) if len(v) else [], pa.float64())


def first_axis_projection(scores: DataFrame) -> DataFrame:
    """Projection of ``x − centroid`` on its first singular axis, sign fixed by the largest component.

    Each task sums D×D products; only one small matrix per group crosses the shuffle and is
    decomposed in a task.
    """
    gram = _partial_gram(scores)
    axes = materialise(
        gram.groupBy("group")
        .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("gram")))).alias("gram"))
        .select("group", _leading_axis("gram").alias("axis")),
        "axes",
    )
    return scores.join(axes, "group").select("group", "id", _project("vec", "centroid", "axis").alias("proj1"))


def _partial_gram(scores: DataFrame) -> DataFrame:
    def rows(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([int(k) for k in total], pa.int64()), list_column(np.stack([t.ravel() for t in total.values()]))],
            names=["group", "gram"],
        )

    limit = HELD_BYTES

    def run(batches):
        total: dict = {}
        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False)
            m = matrix(b.column(1)) - matrix(b.column(2)) if b.num_rows else None
            for key in np.unique(g):
                x = m[g == key]
                total[key] = total.get(key, 0) + x.T @ x
                # Many groups: hand over partial sums instead of holding a matrix for each.
                if len(total) * total[key].nbytes > limit:
                    yield rows(total)
                    total = {}
        if total:
            yield rows(total)

    return scores.select(F.col("group").cast("bigint"), "vec", "centroid").mapInArrow(run, "group bigint, gram array<double>")
