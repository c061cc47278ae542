"""Neighbourhood metrics, percentiles and coordinate lookup around kNN results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tesselar.functions import scalars, vectors
from tesselar.functions.vectors import list_column, matrix
from tesselar.operators.grid import nearest_in_plane
from tesselar.operators.pairwise import nearest
from tesselar.scale import materialise, ranked

GALLERY_K = 8
FETCH_K = 64
REFERENCE_QUERIES = 200


def display_filter(pool: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Restrict to the display allow-list; an empty list, or one covering everything, changes nothing."""
    if allowed is None or allowed.isEmpty():
        return pool
    return pool.join(allowed.select("id").distinct(), "id", "left_semi")


def projection_vectors(cells: DataFrame) -> DataFrame:
    return cells.select("id", F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y"))


@arrow_udf(T.ArrayType(T.DoubleType()))
def _spread(groups: pa.Array, query: pa.Array) -> pa.Array:
    counts = np.diff(groups.offsets.to_numpy())
    m = matrix(groups.flatten())
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    mean = np.add.reduceat(m, starts, axis=0) / counts[:, None]
    d = np.linalg.norm(m - np.repeat(mean, counts, axis=0), axis=1)
    compact = np.add.reduceat(d, starts) / counts
    diff = np.linalg.norm(matrix(query) - mean, axis=1)
    return list_column(np.column_stack([compact, diff]))


def local_structure(neighbours: DataFrame, features: DataFrame) -> DataFrame:
    """Per query: mean distance of the neighbours to their mean, and distance of the query to it.

    A query has at most k neighbours, so the collected group is bounded.
    """
    near = neighbours.select("query", "id", F.lit(False).alias("own"))
    own = neighbours.select("query").distinct().select("query", F.col("query").alias("id"), F.lit(True).alias("own"))
    # One pass over the vectors serves the neighbours and the queries themselves.
    grouped = near.unionByName(own).join(vectors.representation(features), "id").groupBy("query").agg(
        F.collect_list(F.when(~F.col("own"), F.col("vec"))).alias("near"),
        F.first(F.when(F.col("own"), F.col("vec")), ignorenulls=True).alias("own"),
    )
    m = grouped.filter(F.col("own").isNotNull() & (F.size("near") > 0)).select("query", _spread("near", "own").alias("m"))
    return m.select("query", F.col("m")[0].alias("compactness"), F.col("m")[1].alias("difference"))


def neighbours_of(
    features: DataFrame,
    cells: DataFrame | None,
    query_ids: DataFrame,
    k: int,
    metric: str = "cosine",
    space: str = "embedding",
    allowed: DataFrame | None = None,
) -> DataFrame:
    """``(query, id, similarity, rank)``; neighbours by cosine or by distance on the 2-D projection.

    The projection search falls back to cosine when the cells carry no projection.
    """
    rep = vectors.representation(features, metric)
    wanted = query_ids.select("id").distinct()
    has_projection = cells is not None and {"umap2_x", "umap2_y"} <= set(cells.columns)
    if space == "embedding" or not has_projection:
        near = nearest(rep.join(wanted, "id", "left_semi"), display_filter(rep, allowed), k)
        return near.withColumnRenamed("score", "similarity")
    points = projection_vectors(cells)
    near = nearest_in_plane(points.join(wanted, "id", "left_semi"), display_filter(points, allowed), k)
    own = rep.select(F.col("id").alias("query"), F.col("vec").alias("own"))
    return (
        near.drop("score").join(rep, "id").join(own, "query")
        .withColumn("similarity", scalars.clip(vectors.dot("vec", "own"), -1.0, 1.0))
        .select("query", "id", "similarity", "rank")
    )


def hash_sample(ids: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` ids in a fixed hash order (an operator that samples by design).  For sizes of a few
    hundred: every task keeps only its own first ``size``."""
    return ids.select("id").orderBy(scalars.order_hash(F.col("id"), seed), "id").limit(size)


def percentile_reference(features, cells, k, metric="cosine", space="embedding", sample_size=REFERENCE_QUERIES, allowed=None) -> DataFrame:
    """Compactness and difference of a fixed sample of queries."""
    sample = hash_sample(features, sample_size)
    near = materialise(neighbours_of(features, cells, sample, k, metric, space, allowed), "near")
    return local_structure(near, features)


def percentile_columns(values: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """Fraction of the size-limited reference sample at or below each value, as ``<column>_pct``."""
    rows = reference.select(*[F.round(c, 9) for c in columns]).collect()

    def fraction(i: int, c: str):
        ref = np.sort(np.array([r[i] for r in rows], dtype=np.float64))

        @arrow_udf(T.DoubleType())
        def run(v: pa.Array) -> pa.Array:
            at_most = np.searchsorted(ref, v.to_numpy(zero_copy_only=False), side="right")
            return pa.array(at_most / max(1, len(ref)), pa.float64())

        return run(F.round(c, 9))

    return values.withColumns({f"{c}_pct": fraction(i, c) for i, c in enumerate(columns)})


def fraction_at_most(probes: DataFrame, reference: DataFrame) -> DataFrame:
    """``(key, value, fraction)`` of an unbounded reference that is ≤ each probe value.

    Probes and reference are ranked together and the probes among themselves; the difference of both ranks counts the
    reference rows before a probe, whatever the size of either side.
    """
    p = probes.select(F.col("key"), F.round("value", 9).alias("value"))
    ref = reference.select(F.round("value", 9).alias("value"))
    total = ref.agg(F.count("*").alias("n")).scalar()
    both = p.select("key", "value", F.lit(1).alias("probe")).unionByName(
        ref.select(F.monotonically_increasing_id().cast("bigint").alias("key"), "value", F.lit(0).alias("probe"))
    )
    # Round values compared as such: the reference sorts before a probe of the same value.
    place = ranked(both, [], ["value", "probe", "key"], "_all").filter("probe = 1")
    among = ranked(p, [], ["value", "key"], "_own").select("key", "_own")
    return place.join(among, "key").select(
        "key", "value", ((F.col("_all") - F.col("_own")) / F.nullif(total, F.lit(0))).alias("fraction")
    )


def coordinates_for(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """Left join of ids to their coordinates; an unknown id keeps a bare row."""
    known = cells.select(
        "id",
        F.col("X_centroid").alias("raw_x"),
        F.col("Y_centroid").alias("raw_y"),
        "umap2_x",
        "umap2_y",
        scalars.resolve_label(cells.columns, fallback="mod").alias("label"),
    )
    return ids.join(known, "id", "left")


def displayable(neighbours: DataFrame, points: DataFrame, k: int = GALLERY_K) -> DataFrame:
    """First k neighbours per query that exist among the display points."""
    order = Window.partitionBy("query").orderBy("rank", "id")
    return (
        neighbours.join(points.select("id").distinct(), "id", "left_semi")
        .withColumn("shown", F.row_number().over(order))
        .filter(F.col("shown") <= k)
    )


def similarity_ranks(neighbours: DataFrame) -> DataFrame:
    """Rank map per query: the query itself is 0, neighbours follow in order."""
    own = neighbours.select("query").distinct().select("query", F.col("query").alias("id"), F.lit(0).cast("bigint").alias("position"))
    return own.unionByName(neighbours.select("query", "id", F.col("rank").cast("bigint").alias("position")))


def validation_report(features: DataFrame, query_id: int, k: int = 5) -> DataFrame:
    """Norm statistics, self-similarity and the nearest neighbours of one query."""
    norm = F.sqrt(F.aggregate(vectors.sanitise(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x))
    rep = vectors.representation(features)
    q = rep.filter(F.col("id") == query_id)
    near = materialise(nearest(q, rep, k), "near")
    own = q.select(scalars.clip(vectors.dot("vec", "vec"), -1.0, 1.0).alias("s"))
    return features.withColumn("_n", norm).agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).cast("bigint").alias("dim"),
        F.min("_n").alias("norm_min"),
        F.avg("_n").alias("norm_mean"),
        F.max("_n").alias("norm_max"),
        F.sum((F.col("_n") == 0).cast("bigint")).alias("num_zero"),
        F.sum((F.isnan("_n") | (F.col("_n") == float("inf"))).cast("bigint")).alias("num_nan"),
    ).withColumns(
        {
            "self_similarity": own.scalar(),
            "top1_similarity": near.filter("rank = 1").select("score").scalar(),
            "top_ids": near.agg(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda t: t["id"].cast("string")), ",").alias("t")
            ).scalar(),
        }
    )
