"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``links(a, b)`` → (id, root): every linked id with the smallest id that it reaches.

    Each round hangs every neighbour on the smallest one it knows; the number of rounds grows with the logarithm of the
    longest chain.  Minima are combined before the shuffle and the joins are plain equi-joins, whose hot keys Spark
    splits.  Each round is written to the shared folder.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links",
    )
    mark = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "star")
        before, now = now, mark(edges)
        if now == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` places under the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
