"""Cluster outlines: distributed 2-D convex hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
DIRECTIONS = 32
MARGIN = 1e-9  # relative; a point this near to an edge counts as on it


def _cross(a: np.ndarray, b: np.ndarray) -> float:
    return a[0] * b[1] - a[1] * b[0]


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices without collinear points, starting at the lowest x, then y."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and _cross(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = chain(p), chain(p[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _hulls(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for label, g in pdf.groupby("label"):
        h = hull(g[["x", "y"]].to_numpy())
        out.append(pd.DataFrame({"label": label, "ord": np.arange(len(h)), "x": h[:, 0] if len(h) else [], "y": h[:, 1] if len(h) else []}))
    return pd.concat(out) if out else pd.DataFrame({"label": [], "ord": [], "x": [], "y": []})


def outer_points(points: DataFrame) -> DataFrame:
    """``points(label, x, y)`` without those inside the polygon of their label's extreme points.

    The farthest points in fixed directions are corners of the hull, so nothing strictly inside them is on it.  What is
    left of an even cloud is about one row in a hundred.
    """
    turns = [2.0 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    away = [F.col("x") * math.cos(t) + F.col("y") * math.sin(t) for t in turns]
    far = [F.struct(F.max_by("x", a).alias("x"), F.max_by("y", a).alias("y")) for a in away]
    ring = points.groupBy("label").agg(*[f.alias(f"_{i}") for i, f in enumerate(far)])
    ring = ring.select("label", F.array_distinct(F.array(*[F.col(f"_{i}") for i in range(DIRECTIONS)])).alias("_ring"))
    following = F.concat(F.expr("slice(_ring, 2, size(_ring))"), F.slice("_ring", 1, 1))
    edge = lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))
    ring = ring.select("label", F.zip_with("_ring", following, edge).alias("_edges"))

    def left_of(e):
        one, two = e["dx"] * (F.col("y") - e["y"]), e["dy"] * (F.col("x") - e["x"])
        return one - two > MARGIN * (F.abs(one) + F.abs(two))

    inside = (F.size("_edges") > 2) & F.forall("_edges", left_of)
    return points.join(ring, "label").filter(~inside).select("label", "x", "y")


def cluster_hulls(points: DataFrame) -> DataFrame:
    """``(label, ord, x, y)`` hull vertices of ``points(label, x, y)``; labels under three points drop.

    Points inside the polygon of extreme points leave first, by built-in functions.  Tasks reduce what is left of their
    own batches to hull vertices; vertices meet in ``FAN_IN`` buckets per label and only those hulls meet in the last step,
    so a label that holds a third of all points reaches its final task as hull vertices only.
    """
    schema = "label bigint, ord bigint, x double, y double"
    finite = points.select(F.col("label").cast("bigint").alias("label"), "x", "y").filter("label is not null")
    finite = finite.filter("not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")

    def local(batches):
        for pdf in batches:
            if len(pdf):
                yield _hulls(pdf)

    first = outer_points(finite).mapInPandas(local, schema)
    bucket = F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("bucket")
    second = first.select("label", "x", "y", bucket).groupBy("label", "bucket").applyInPandas(
        lambda pdf: _hulls(pdf[["label", "x", "y"]]), schema
    )
    last = second.groupBy("label").applyInPandas(lambda pdf: _hulls(pdf[["label", "x", "y"]]), schema)
    whole = last.groupBy("label").agg(F.count("*").alias("_v")).filter("_v >= 3")
    return last.join(whole, "label").drop("_v")


def cluster_outlines(points: DataFrame) -> DataFrame:
    """``(label, n, center_x, center_y, path)`` with a closed path of ``struct(x, y)`` vertices."""
    h = cluster_hulls(points)
    ring = h.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("v"))
    ring = ring.select(
        "label",
        F.transform(F.concat("v", F.slice("v", 1, 1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"),
    )
    centre = points.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count("*").alias("n"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y")
    )
    return centre.join(ring, "label")
